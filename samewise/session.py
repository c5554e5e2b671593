"""Session helpers: a tuned session and the package's path on the executors."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "samewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow transfer; conf adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Python workers of the session find this package where it lies beside the driver's.

    On a cluster the package is installed or sent with --py-files; the added
    path is then without effect.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
