"""Files that arrive over time: each is parsed once and added to a table.

The file source and the checkpoint give every file to exactly one batch; a batch
that is repeated after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Limits, parse_files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_a_batch).load(folder)


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, limits: Limits = Limits(), once: bool = True) -> StreamingQuery:
    """Parses arriving files into target, partitioned by batch; with once it ends when all present files are done."""

    def put(batch: DataFrame, number: int) -> None:
        rows = parse_files(batch, limits=limits)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arriving(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def expired(rows: DataFrame, column: str, days: int) -> DataFrame:
    """Rows older than the retention."""
    return rows.where(F.col(column) < F.current_timestamp() - F.make_interval(days=F.lit(days)))


def backoff_seconds(attempt):
    """Wait before a retry: 15, 60, 240 seconds."""
    return F.lit(15) * F.pow(F.lit(4), attempt - 1)
