"""Data-quality report of a table under a mapping: one aggregation over the rows, one more for repeated ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import parse_number
from ..functions.text import blank, squeeze

LISTED, LONG = 200, 2000


@dataclass
class Report:
    kind: str
    rows_read: int
    rows_ready: int
    blocking: list[str] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    columns: list[dict] = field(default_factory=list)


def fill_percent(filled: Column, total: Column) -> Column:
    """Whole percent of filled cells; 100 only if all are."""
    return F.when(total == 0, 0).when(filled == total, 100).otherwise(F.least(F.lit(99), F.floor(filled * 100 / total))).cast("int")


def column_stats(rows: DataFrame, columns: list[str], row: str = "row_number") -> DataFrame:
    """(column, filled, total, fill_percent, sample): the sample is the first filled cell, at most 120 characters."""
    cells = rows.select(F.col(row).alias("r"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("c"))
    some = ~blank(F.col("c.v"))
    agg = cells.groupBy(F.col("c.column").alias("column")).agg(F.count_if(some).alias("filled"), F.count("*").alias("total"), F.min(F.when(some, F.struct("r", F.substring(squeeze(F.col("c.v")), 1, 120).alias("v")))).alias("s"))
    return agg.select("column", "filled", "total", fill_percent(F.col("filled"), F.col("total")).alias("fill_percent"), F.coalesce("s.v", F.lit("")).alias("sample"))


def duplicate_values(df: DataFrame, column: str, row: str) -> DataFrame:
    """(value, n, rows): values that stand in more than one row, with the first of these."""
    value = F.trim(F.col(column).cast("string"))
    agg = df.where(~blank(F.col(column).cast("string"))).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(row).alias("first_row"), F.max(row).alias("last_row"))
    return agg.where("n > 1")


def malformed_reasons(rows: DataFrame, reason: str = "malformed_reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def _found(df: DataFrame, tests: dict[str, Column], row: str) -> dict[str, tuple[int, list[int]]]:
    """Count of every test in one pass, and the first LISTED rows of those that found any."""
    if not tests:
        return {}
    aggs = []
    for k, test in tests.items():
        aggs.append(F.count_if(test).alias(f"n_{k}"))
    counts = df.agg(*aggs).first()
    return {k: (counts[f"n_{k}"], [r[0] for r in df.where(test).orderBy(row).limit(LISTED).select(row).collect()] if counts[f"n_{k}"] else []) for k, test in tests.items()}


def build_report(rows: DataFrame, columns: list[str], mapping: dict[str, str | None], kind: str, row: str = "row_number") -> Report:
    """rows(row_number, values map, malformed_reason)."""
    good, bad = rows.where("malformed_reason is null"), rows.where("malformed_reason is not null")
    flat = good.select(row, *(F.coalesce(F.try_element_at("values", F.lit(c)), F.lit("")).alias(c) for c in columns))
    cell = lambda k: F.col(f"`{mapping[k]}`")
    has = lambda k: mapping.get(k) is not None
    total, n_bad = flat.count(), bad.count()
    report = Report(kind, total + n_bad, 0)

    def warn(code: str, severity: str, count: int = 0, listed: list[int] | None = None) -> None:
        report.warnings.append({"code": code, "severity": severity, "count": count, "rows": listed or []})

    if n_bad:
        warn("malformed_rows", "warning", n_bad, [r[0] for r in bad.orderBy(row).limit(LISTED).select(row).collect()])
    name, code = ("item_name", "item_code") if kind == "catalogue" else ("title", "external_id")
    tests: dict[str, Column] = {}
    if has(name):
        tests["empty"] = blank(cell(name))
        extra = ("part_number",) if kind == "catalogue" else ("description",)
        for k in extra:
            if has(k):
                tests["missing"] = ~blank(cell(name)) & blank(cell(k))
        if kind == "tasks" and has("description"):
            tests["long"] = ~blank(cell(name)) & (F.char_length(cell("description")) > LONG)
    money = [k for k in ("stock", "unit_cost") if kind == "catalogue" and has(k)]
    if money:
        broken = F.lit(False)
        for k in money:
            broken = broken | ~parse_number(cell(k))["ok"]
        tests["number"] = broken
    found = _found(flat, tests, row)
    if not has(name):
        report.blocking.append("no_name_column" if kind == "catalogue" else "no_title_column")
    else:
        n, listed = found["empty"]
        report.rows_ready = total - n
        if n:
            warn("empty_names" if kind == "catalogue" else "empty_titles", "warning", n, listed)
        if not report.rows_ready:
            report.blocking.append("no_usable_items" if kind == "catalogue" else "no_usable_rows")
    if has(code):
        again = duplicate_values(flat, mapping[code], row).agg(F.sum("n")).first()[0]
        if again:
            warn("duplicate_item_codes" if kind == "catalogue" else "duplicate_ids", "warning", again)
    else:
        warn("no_item_code_column" if kind == "catalogue" else "no_id_column", "info")
    if kind == "catalogue":
        if not has("part_number"):
            warn("no_part_number_column", "info")
        elif found.get("missing", (0,))[0]:
            warn("missing_part_numbers", "info", *found["missing"])
        if not has("brand"):
            warn("no_brand_column", "info")
        lacking = {(True, True): "no_stock_or_cost", (True, False): "no_stock_column", (False, True): "no_cost_column"}.get((not has("stock"), not has("unit_cost")))
        if lacking:
            warn(lacking, "info")
        if found.get("number", (0,))[0]:
            warn("not_a_number", "warning", *found["number"])
        if has("unit_cost"):
            marks = flat.select(parse_number(cell("unit_cost"))["currency"].alias("c")).where("c is not null").distinct()
            if marks.count() > 1:
                warn("mixed_currencies", "warning")
    else:
        if not has("description"):
            warn("no_description_column", "warning")
        elif found.get("missing", (0,))[0]:
            n, listed = found["missing"]
            warn("missing_descriptions", "warning" if 2 * n > report.rows_ready else "info", n, listed)
        if found.get("long", (0,))[0]:
            warn("long_descriptions", "info", *found["long"])
    report.warnings.sort(key=lambda w: w["severity"] != "warning")
    fields = {c: k for k, c in mapping.items() if c}
    stats = {s.column: s for s in column_stats(flat, columns, row).collect()} if columns else {}
    report.columns = [{"name": c, "field": fields.get(c), "fill_percent": stats[c].fill_percent if c in stats else 0, "sample": stats[c].sample if c in stats else ""} for c in columns]
    return report
