"""Tables of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import importable
from ..sources.tables import written

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows: texts are long, and both JVM and Python hold a batch for each task.

    The package's path goes to the Python workers too.
    """
    importable(spark)
    if int(spark.conf.get(BATCH_ROWS, None) or 10_000) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["small_batches", "table", "written"]
