from __future__ import annotations

import corpus_pipeline as cp
from samewise.llm.tables import written

from .helpers import AWKWARD, docs


def test_stages_keep_columns_and_filter(spark, data):
    at = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = at.columns, at.count()
    for name, stage in cp.STAGES[:-1]:
        at = written(stage(spark, at, data), name)
        assert at.columns == columns and 0 < at.count() <= n
        n = at.count()
    last = cp.STAGES[-1][1](spark, at, data)
    assert last.count() == n and last.where("not exact").count() == 0
    assert cp.run(spark, data).count() == n


def test_stages_on_awkward_rows(spark, data):
    for name, stage in cp.STAGES:
        out = stage(spark, docs(spark, AWKWARD), data).collect()
        assert len(out) <= len(AWKWARD), name
        assert stage(spark, docs(spark, []), data).count() == 0
