"""Stock and money of groups, the headline, and standard names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import lexicon as lx

COST_GAP = 0.20


def unit_key(unit: Column, pack: Column) -> Column:
    """each where a pack size is known or the unit means single pieces, else the unit's letters and digits."""
    word = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"(?U)[^\w]", "")
    return F.when(F.coalesce(pack, F.lit(0)) > 0, "each").when(word.isin(*lx.SINGLE_UNITS), "each").otherwise(word)


def group_figures(members: DataFrame, key: str = "cluster", money_ok: bool | Column = True) -> DataFrame:
    """(key, stock_total, stock_on_duplicates, value_on_duplicates, cost_low, cost_high, units_differ).

    members(key, role, stock, pack, unit, unit_cost).  Stock below zero counts
    as zero.  Totals of stock need units that can be compared; money needs one currency.
    """
    ok = F.lit(money_ok) if isinstance(money_ok, bool) else money_ok
    pack = F.coalesce(F.col("pack"), F.lit(1))
    pieces = F.greatest(F.coalesce(F.col("stock"), F.lit(0.0)) * pack, F.lit(0.0))
    spare = F.col("role") != "master"
    value = F.greatest(F.coalesce(F.col("stock"), F.lit(0.0)), F.lit(0.0)) * F.coalesce(F.col("unit_cost"), F.lit(0.0))
    each = F.col("unit_cost") / pack
    agg = members.groupBy(key).agg(
        F.bool_or(F.col("stock").isNotNull()).alias("has_stock"),
        F.bool_or(F.col("unit_cost").isNotNull()).alias("has_cost"),
        F.min(unit_key(F.col("unit"), F.col("pack"))).alias("unit_low"),
        F.max(unit_key(F.col("unit"), F.col("pack"))).alias("unit_high"),
        F.sum(pieces).alias("total"),
        F.sum(F.when(spare, pieces).otherwise(0.0)).alias("spare"),
        F.sum(F.when(spare, value).otherwise(0.0)).alias("value"),
        F.min(each).alias("low"),
        F.max(each).alias("high"),
    )
    comparable = F.col("unit_low") == F.col("unit_high")
    stocked = F.col("has_stock") & comparable
    return agg.select(
        key,
        F.when(stocked, F.bround("total", 3)).alias("stock_total"),
        F.when(stocked, F.bround("spare", 3)).alias("stock_on_duplicates"),
        F.when(F.col("has_stock") & F.col("has_cost") & ok, F.bround("value", 2)).alias("value_on_duplicates"),
        F.when(ok, F.bround("low", 4)).alias("cost_low"),
        F.when(ok, F.bround("high", 4)).alias("cost_high"),
        (F.col("has_stock") & ~comparable).alias("units_differ"),
    )


def currencies(items: DataFrame, default: str) -> DataFrame:
    """One row: the distinct currencies of rows with a cost, sorted; unmarked costs are in the default one."""
    return items.where(F.col("unit_cost").isNotNull()).agg(F.array_sort(F.collect_set(F.coalesce("currency", F.lit(default)))).alias("currencies"))


def headline(figures: DataFrame) -> DataFrame:
    """One row of sums over groups, with the groups whose costs lie more than a fifth apart."""
    gap = (F.col("cost_low") != 0) & (F.col("cost_high") != 0) & ((F.col("cost_high") - F.col("cost_low")) > COST_GAP * F.col("cost_low"))
    return figures.agg(
        F.bround(F.sum("stock_on_duplicates"), 3).alias("units_on_duplicates"),
        F.bround(F.sum("value_on_duplicates"), 2).alias("value_on_duplicates"),
        F.count_if(gap).alias("groups_with_cost_gap"),
        F.count_if("units_differ").alias("groups_units_differ"),
    )


def _plain(v: float) -> str:
    return f"{v:g}"


def compose_name(n: dict, master: dict, fallback: str) -> str:
    """Head, describing words, brand and part, sizes, grades, colours; from the norm of the source row and of the master."""
    pick = lambda k: n.get(k) or master.get(k)
    brand, part, variants, types = pick("brand") or "", pick("part_base") or "", list(pick("variants") or []), list(pick("types") or [])
    dims, materials = n.get("dims") or {}, list(n.get("materials") or [])
    left_out = {brand, part, *variants, *lx.NAME_STOPS, *lx.CONTAINERS, *lx.COLOURS, *lx.MATERIALS}
    left_out |= {c for c in n.get("codes") or [] if part and c.startswith(part)}
    words = []
    for w in (n.get("core") or n.get("text") or "").split():
        names_type = bool(types) and lx.TYPES.get(w) == types[0] and w.rstrip("s") == types[0]
        if w not in left_out and w not in words and not names_type and len(w) > 1 and any(c.isascii() and c.isalnum() for c in w):
            words.append(w)
    shown = [w.upper() if w in lx.ACRONYMS or any(c.isdigit() for c in w) else w.capitalize() for w in words]
    ident = part.upper() + ("-" + "/".join(variants).upper() if part and variants else "")
    sized = lambda k: list(dims.get(k) if dims.get(k) is not None else [])
    specs = []
    if dims.get("thread"):
        specs.append(dims["thread"].upper() + "".join(f" x {_plain(v)} mm" for v in sized("length_mm")[:1]))
    elif sized("length_mm"):
        specs.append(f"{_plain(sized('length_mm')[0])} mm")
    if sized("sizes_mm"):
        specs.append(" x ".join(map(_plain, sized("sizes_mm"))) + " mm")
    specs += [f"{_plain(sized(k)[0])} {unit}" for k, unit in (("power_w", "W"), ("voltage_v", "V"), ("current_a", "A")) if sized(k)]
    if dims.get("poles"):
        specs.append(f"{int(dims['poles'])}P")
    graded = [m.split(":")[1].upper() for m in materials if not m.startswith("material:")] + [m.split(":")[1].capitalize() for m in materials if m.startswith("material:")]
    parts = [types[0].capitalize() if types else "", " ".join(shown), " ".join(x for x in (brand.upper(), ident) if x), *specs, " ".join(graded), "/".join(c.capitalize() for c in n.get("colours") or [])]
    return ", ".join(p for p in parts if p) or fallback[:120]


def _deep(v):
    """Rows and arrays inside a pandas struct as plain values."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: _deep(x) for k, x in v.items()}
    return v.tolist() if hasattr(v, "tolist") else v


@pandas_udf(StringType())
def standard_name(source: pd.DataFrame, master: pd.DataFrame, name: pd.Series) -> pd.Series:
    rows = zip(source.to_dict("records"), master.to_dict("records"), name, strict=True)
    return pd.Series([compose_name(_deep(a), _deep(b), c or "") for a, b, c in rows])


def standard_names(members: DataFrame) -> DataFrame:
    """(cluster, name_standard) from members with role, norm and name: told by the master, or by the longest Latin name if the master's is Arabic."""
    core_words = F.size(F.split(F.coalesce("norm.core", F.lit("")), " "))
    latin = F.col("norm.script") != "arabic"
    is_master = F.col("role") == "master"
    rank = F.struct((is_master & latin).alias("own"), F.when(latin, core_words).otherwise(-1).alias("words"), (-F.col("row")).alias("first"))
    told = members.groupBy("cluster").agg(F.max_by("norm", rank).alias("told"), F.max_by("norm", is_master).alias("master"), F.max_by("name", is_master).alias("name"))
    return told.select("cluster", standard_name("told", "master", "name").alias("name_standard"))
