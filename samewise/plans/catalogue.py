"""Catalogue relations: from files under a mapping, or derived from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import alike
from ..operators.normalise import FIELDS, with_features, with_norm
from ..sources.mapping import Mapping


def derived(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """catalogue(row, code, name, brand, stock, unit_cost, *more) from part and the quantities sold; more are columns of part.

    Few bytes of names are much work to normalise, so rows are dealt by their key
    over all cores, as the join needs them anyway; adaptive execution would leave a small table in one task.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sold = read("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("stock"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = read("part").repartition(tasks, "p_partkey").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    name = F.concat("p_name", F.lit(" M"), (F.col("p_size") % 17 + 3).cast("string"), F.lit(" "), F.lower("p_type"))
    return part.select(F.col("p_partkey").alias("row"), F.col("p_partkey").cast("string").alias("code"), name.alias("name"), F.lower("p_brand").alias("brand"), "stock", F.col("p_retailprice").alias("unit_cost"), *more)


def items_of(catalogue: DataFrame, ascii_only: bool = False) -> DataFrame:
    """items(row, code, name, unit, norm, tokens, trigrams) of a catalogue with columns named as in derived(); unit, part and details may be there too."""
    have = set(catalogue.columns)
    known = {"item_name": "name", "brand": "brand", "stock": "stock", "unit_cost": "unit_cost", "unit": "unit", "part_number": "part", "details": "details"}
    fields = {k: F.col(c) for k, c in known.items() if c in have}
    unit = F.col("unit").cast("string") if "unit" in have else F.lit(None).cast("string")
    code = F.col("code").cast("string") if "code" in have else F.lit(None).cast("string")
    base = catalogue.select(F.col("row").cast("long").alias("row"), code.alias("code"), F.col("name").cast("string").alias("name"), unit.alias("unit"), *(c for f, c in known.items() if c in have and c not in ("name", "unit")))
    named = base.where(~blank(F.col("name")))
    return with_features(with_norm(named, fields, ascii_only).select("row", "code", "name", "unit", "norm"))


def texts_of(catalogue: DataFrame, told: tuple[str, ...] = (), member: Column | None = None) -> DataFrame:
    """texts(name, members, norm, tokens, trigrams): the rows of one name, brand and part number, in chunks, normalised once.

    Of norm only what comparing reads has a value.  Rows that differ in the columns
    ``told``, which are kept, stand apart; members are row numbers unless told otherwise.
    """
    cell = lambda c: (F.col(c) if c in catalogue.columns else F.lit(None)).cast("string").alias(c)
    by = ["name", "brand", "part", *told]
    rows = catalogue.where(~blank(F.col("name").cast("string"))).select(F.col("row").cast("long").alias("row"), cell("name"), cell("brand"), cell("part"), *(c for c in catalogue.columns if c not in ("row", "name", "brand", "part")))
    chunked = alike.chunks(rows, by, F.col("row") if member is None else member)
    fields = {"item_name": F.col("name"), "brand": F.col("brand"), "part_number": F.col("part")}
    return with_features(with_norm(chunked, fields).select("name", "members", *told, "norm"))


def from_rows(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """A catalogue from file rows(row_number, values) under a mapping; malformed rows are left out."""
    cell = lambda k: F.try_element_at("values", F.lit(mapping[k])) if mapping.get(k) else F.lit(None).cast("string")
    names = {"item_name": "name", "part_number": "part", "item_code": "code"}
    good = rows.where("malformed_reason is null and error is null") if "error" in rows.columns else rows.where("malformed_reason is null")
    return good.select(F.col("row_number").alias("row"), *(cell(k).alias(names.get(k, k)) for k in FIELDS))
