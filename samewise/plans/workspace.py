"""A tenant's datasets: the only way to its rows, always filtered by tenant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, report
from ..sources import files, mapping, sinks
from . import analysis, catalogue


def visible(df: DataFrame, org: str | None, column: str = "org_id") -> DataFrame:
    """Rows of one tenant; none without a tenant.  On data partitioned by the column this also prunes partitions."""
    return df.where(F.lit(False) if org is None else F.col(column) == F.lit(org))


def visible_users(users: DataFrame, memberships: DataFrame, org: str | None, user: str = "user_id") -> DataFrame:
    """Users with a membership in the tenant."""
    return users.join(visible(memberships, org).select(user), user, "left_semi")


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page under a total order; at most 200 rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows and begins at 0 or later")
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass
class Dataset:
    """Rows of text with their meaning; immutable: with_mapping, with_kind and decide give new ones, so results never outlive what they rest on."""

    rows: DataFrame
    columns: list[str]
    kind: str
    mapping: mapping.Mapping
    log: DataFrame
    _analysis: analysis.Analysis | None = field(default=None, repr=False)

    def with_mapping(self, new: mapping.Mapping) -> Dataset:
        return replace(self, mapping=mapping.validate(new, self.columns, self.kind), _analysis=None)

    def with_kind(self, kind: str) -> Dataset:
        return replace(self, kind=kind, mapping=mapping.auto_map(self.columns, kind), _analysis=None)

    def decide(self, action: str, rows: list[int]) -> Dataset:
        return replace(self, log=decisions.appended(self.log, action, rows), _analysis=None)

    def report(self) -> report.Report:
        return report.build_report(self.rows, self.columns, self.mapping, self.kind)

    def analyse(self, make_reviewer: Callable | None = None, max_reviews: int = 0, currency: str = "GBP") -> analysis.Analysis:
        if self._analysis is None:
            if self.kind != "catalogue":
                raise ValueError("only catalogues are analysed")
            items = catalogue.items_of(catalogue.from_rows(self.rows, self.mapping))
            self._analysis = analysis.analyse(items, self.log, make_reviewer, max_reviews, currency)
        return self._analysis

    def export(self) -> DataFrame:
        """The original columns of all rows, malformed ones too, with the added ones."""
        found = self.analyse().export().withColumnRenamed("row", "row_number")
        flat = self.rows.select("row_number", *(F.try_element_at("values", F.lit(c)).alias(c) for c in self.columns))
        names = sinks.headers(self.columns)
        joined = flat.join(found, "row_number", "left")
        role = F.coalesce(F.col(sinks.ADDED[1]), F.lit("not_analysed"))
        added = [(role if a == sinks.ADDED[1] else F.coalesce(F.col(a), F.lit(""))).alias(n) for a, n in zip(sinks.ADDED, names, strict=True)]
        return joined.orderBy("row_number").select(*(F.col(f"`{c}`") for c in self.columns), *added)


class Workspace:
    """Files of one tenant in a shared table partitioned by org_id and dataset_id."""

    def __init__(self, spark: SparkSession, org: str, root: str):
        if not org:
            raise ValueError("a workspace needs a tenant")
        self.spark, self.org, self.root = spark, org, root.rstrip("/")

    def ingest(self, path: str, dataset: str, sheet: str | None = None, limits: files.Limits = files.Limits()) -> Dataset:
        """Reads a file, keeps its rows (malformed ones too) and maps its columns."""
        rows = files.read_files(self.spark, path, sheet, limits)
        refused = rows.where("error is not null").select("error").first()
        if refused:
            raise files.FileError(refused.error)
        kept = rows.select(F.lit(self.org).alias("org_id"), F.lit(dataset).alias("dataset_id"), "columns", "row_number", "values", "malformed_reason")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        kept.write.mode("overwrite").partitionBy("org_id", "dataset_id").parquet(f"{self.root}/rows")
        return self.open(dataset)

    def open(self, dataset: str) -> Dataset:
        rows = visible(self.spark.read.parquet(f"{self.root}/rows"), self.org).where(F.col("dataset_id") == dataset)
        first = rows.select("columns").first()
        if first is None:
            raise KeyError(dataset)
        kind = mapping.detect_kind(first[0])
        return Dataset(rows, first[0], kind, mapping.auto_map(first[0], kind), self.spark.createDataFrame([], decisions.LOG))

    def datasets(self) -> DataFrame:
        return visible(self.spark.read.parquet(f"{self.root}/rows"), self.org).groupBy("dataset_id").agg(F.count("*").alias("rows"))
