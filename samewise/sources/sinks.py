"""Results next to the original columns, as Parquet, CSV, JSON or a workbook."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_safe

PREFIX = "dedupe_"
ADDED = tuple(PREFIX + k for k in "group role master_code confidence reason lookalike_of name_standard brand part_number variant group_stock group_value".split())


def headers(columns: list[str], suffix: str = " (dedupe)") -> list[str]:
    """Names of the added columns; one that the file already uses gets a suffix."""
    return [a if a not in columns else a + suffix for a in ADDED]


def added_columns(items: DataFrame, members: DataFrame, lookalikes: DataFrame, unsure: DataFrame) -> DataFrame:
    """(row, the added columns) for every row of items(row, code, norm, analysed).

    members(row, role, label, confidence, reasons, name_standard, stock_total,
    value_on_duplicates); pairs have a and b.
    """
    blank = F.lit("")
    code_of = items.select("row", F.when(F.coalesce("code", blank) != "", F.col("code")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string"))).alias("shown"))
    masters = members.where("role = 'master'").select("label", F.col("row").alias("m")).join(code_of.withColumnRenamed("row", "m"), "m").select("label", F.col("shown").alias("master_code"))
    both = lookalikes.select("a", "b").union(lookalikes.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    partners = both.join(code_of.select(F.col("row").alias("b"), "shown"), "b").groupBy(F.col("a").alias("row")).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("b", "shown"))), 1, 3), lambda s: s["shown"]), ", ").alias("alike"))
    open_ = unsure.select(F.col("a").alias("row")).union(unsure.select("b")).distinct().withColumn("open", F.lit(True))
    df = items.join(members, "row", "left").join(masters, "label", "left").join(partners, "row", "left").join(open_, "row", "left")
    ok, grouped, master = F.col("analysed"), F.col("label").isNotNull(), F.col("role") == "master"
    shown = lambda c: F.when(ok, F.coalesce(c.cast("string"), blank))
    values = [
        shown(F.col("label")),
        F.when(~ok, "not_analysed").when(grouped, F.col("role")).when(F.col("open"), "needs_review").otherwise("unique"),
        shown(F.col("master_code")),
        shown(F.col("confidence")),
        shown(F.get("reasons", F.lit(0))),
        shown(F.col("alike")),
        shown(F.col("name_standard")),
        shown(F.upper("norm.brand")),
        shown(F.upper("norm.part_base")),
        shown(F.upper(F.array_join("norm.variants", "/"))),
        shown(F.when(master, F.col("stock_total"))),
        shown(F.when(master, F.col("value_on_duplicates"))),
    ]
    return df.select("row", *(v.alias(a) for v, a in zip(values, ADDED, strict=True)))


def safe(df: DataFrame) -> DataFrame:
    """Every column as text that a spreadsheet does not run."""
    return df.select(*(csv_safe(F.col(f"`{c}`")).alias(c) for c in df.columns))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Distributed writers: parquet as it is; csv with safe text and a header; json one object a line."""
    if fmt == "csv":
        safe(df).write.mode(mode).option("header", True).option("quoteAll", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


_PLAIN = re.compile(r"-?(0|[1-9]\d{0,14})(\.\d+)?")
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>%s</Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}


def _name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(records) -> str:
    rows = []
    for i, record in enumerate(records, 1):
        cells = []
        for j, v in enumerate(record, 1):
            text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "" if v is None else str(v))[:32767]
            ref = f"{_name(j)}{i}"
            cells.append(f'<c r="{ref}"><v>{text}</v></c>' if _PLAIN.fullmatch(text) and len(text) < 16 else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        rows.append(f'<row r="{i}">{"".join(cells)}</row>')
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>'


def workbook(tables: dict[str, tuple[list[str], list]]) -> bytes:
    """A workbook of sheets name -> (columns, rows).  Plain numbers are numbers, all else is text, so nothing runs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        numbered = list(enumerate(tables.items(), 1))
        z.writestr("[Content_Types].xml", _PARTS["[Content_Types].xml"] % "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in numbered))
        z.writestr("_rels/.rels", _PARTS["_rels/.rels"])
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in numbered) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>")
        for i, (_, (columns, rows)) in numbered:
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet([columns, *rows]))
    return out.getvalue()


def write_workbook(df: DataFrame, summary: dict, most: int = 1_048_575) -> bytes:
    """Items and summary as a workbook; a sheet holds a million rows, so more are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a workbook; write parquet or csv")
    return workbook({"Items": (df.columns, [tuple(r) for r in rows]), "Summary": (["figure", "value"], list(summary.items()))})
