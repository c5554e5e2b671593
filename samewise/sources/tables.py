"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one where none is set and all runs in this process.

    On a cluster without one this is an error: executors do not see each other's disks.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="samewise-"))
    return spark.sparkContext.getCheckpointDir()


def _files(spark: SparkSession) -> int:
    """How many tasks write a table at most: several for each core, or an eighth of a shuffle's partitions.

    Each file costs the shared store some requests, so small tables dealt over
    many partitions are not written as many tiny files.
    """
    return max(4 * spark.sparkContext.defaultParallelism, ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / 8))


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; scratch collects paths for ``remove``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/samewise-{uuid.uuid4().hex}"
    df.coalesce(_files(spark)).write.parquet(f"{folder}/{name}")
    if scratch is not None:
        scratch.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def remove(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for folder in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
