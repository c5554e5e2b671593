"""Catalogue rows to typed attributes, as one chain of projections with two Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as at
from ..functions import lexicon as lx
from ..functions import text as tx

VERSION = 4
FIELDS = ("item_name", "details", "part_number", "brand", "item_code", "unit", "stock", "unit_cost")


def with_norm(df: DataFrame, fields: dict[str, Column], ascii_only: bool = False) -> DataFrame:
    """df with a struct column norm; fields maps logical fields to columns, absent ones are null.

    ascii_only leaves out the Unicode steps for sources known to be ASCII.
    """
    kept = df.columns
    get = lambda k: fields.get(k, F.lit(None)).cast("string")
    name = F.coalesce(get("item_name"), F.lit(""))
    df = df.withColumns({f"_{k}": get(k) for k in FIELDS if k != "item_name"}).withColumn("_name", name)
    df = df.withColumns({"_clean": tx.clean(F.col("_name"), ascii_only=ascii_only), "_part_clean": tx.clean(F.col("_part_number"), ascii_only=ascii_only), "_unit_clean": tx.fold(tx.clean(F.col("_unit"), ascii_only=ascii_only))})
    df = df.withColumn("_folded", tx.fold(F.col("_clean"))).withColumn("_text", tx.tidy(F.col("_folded")))
    df = df.withColumn("_words", tx.words(F.col("_text")))
    df = df.withColumns({"_own": at.brand_key(F.col("_brand"), ascii_only), "_said": at.brand_in_words(F.col("_words"))})
    df = df.withColumns({"_stock_n": at.parse_number(F.col("_stock"), ascii_only), "_cost_n": at.parse_number(F.col("_unit_cost"), ascii_only), "_part": at.parse_part("_part_clean", "_clean")})
    df = at.with_measures(df, "_folded")
    bare = F.col("residual")
    for pattern in lx.PACKS:
        bare = F.regexp_replace(bare, pattern, " ")
    df = df.withColumn("_bare", bare)
    core_words = F.filter(tx.words(tx.tidy(F.col("_bare"))), lambda w: ~w.isin(lx.CONTAINERS))
    df = df.withColumn("_core", core_words)
    base = F.coalesce(F.col("_part.part_base"), F.lit(""))
    skip = F.concat(F.array(base, F.concat(base, F.array_join("_part.variants", ""))), F.col("_part.variants"))
    codes = F.array_sort(F.array_distinct(F.filter("_core", lambda w: w.rlike(lx.CODE_WORD) & ~w.isin(list(lx.MATERIALS)))))
    numbers = F.filter(F.array_sort(F.array_distinct(F.regexp_extract_all("_bare", F.lit("(?U)" + lx.FREE_NUMBER), 0))), lambda n: ~((n == base) | ((F.char_length(n) >= 3) & (base.startswith(n) | base.endswith(n)))))
    implied = tx.lookup(lx.IMPLIED)
    materials = tx.found(F.col("_words"), lx.MATERIALS)
    materials = tx.let(materials, lambda m: F.array_sort(F.array_union(m, F.filter(F.transform(m, lambda v: F.try_element_at(implied, v)), lambda v: v.isNotNull()))))
    problems = F.filter(F.array(F.when(~F.col("_stock_n.ok"), "stock_not_number"), F.when(~F.col("_cost_n.ok"), "cost_not_number")), lambda v: v.isNotNull())
    norm = F.struct(
        F.lit(VERSION).alias("v"),
        F.col("_text").alias("text"),
        F.array_join("_core", " ").alias("core"),
        tx.script_of(F.col("_name")).alias("script"),
        F.array_except(codes, skip).alias("codes"),
        F.coalesce("_own", "_said").alias("brand"),
        F.when(F.col("_own").isNotNull(), "column").when(F.col("_said").isNotNull(), "text").alias("brand_source"),
        *(F.col(f"_part.{k}").alias(k) for k in ("part_base", "part_source", "variants", "variant_classes", "part_extra")),
        tx.found(F.col("_words"), lx.TYPES).alias("types"),
        tx.found(F.col("_words"), lx.COLOURS).alias("colours"),
        materials.alias("materials"),
        numbers.alias("numbers"),
        F.col("dims"),
        at.parse_pack(F.col("_unit_clean"), F.col("_folded")).alias("pack"),
        F.col("_stock_n.number").alias("stock"),
        F.col("_cost_n.number").alias("unit_cost"),
        F.col("_cost_n.currency").alias("currency"),
        F.when(F.coalesce(F.col("_details"), F.lit("")) != "", tx.normalise_text(F.col("_details"), tx.DETAILS_CAP, ascii_only)).alias("details_text"),
        F.when(F.size(problems) > 0, problems).alias("problems"),
    )
    return df.select(*(F.col(f"`{c}`") for c in kept), norm.alias("norm"))


def with_features(items: DataFrame) -> DataFrame:
    """items(row, norm, ...) with tokens and trigrams of the core name (the text where the core is empty)."""
    core = F.when(F.coalesce(F.col("norm.core"), F.lit("")) != "", F.col("norm.core")).otherwise(F.coalesce(F.col("norm.text"), F.lit("")))
    return items.withColumn("_n", core).withColumns({"tokens": F.array_distinct(tx.words(F.col("_n"))), "trigrams": tx.trigrams(F.col("_n"))}).drop("_n")
