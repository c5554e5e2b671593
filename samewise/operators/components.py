"""Connected components: union-find within partitions, then alternating stars.

Each partition first replaces its edges by a spanning forest.  Rounds of
large-star and small-star steps then hang every node below the smallest node
of its component.  Edges never reach the driver; a round's result is a written
table, so a lost executor costs at most one round.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, written

FILE_ROWS = 250_000  # rows in a file of a round, about


def _forest(batches):
    """Spanning forest of a partition's edges, each node below its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"]
    )


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60, scratch: list[str] | None = None) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Loops and repeated edges are ignored, no edges give no rows.  The last
    round's table stays; its path goes to scratch.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    held: list[str] = []
    now = written(pairs.mapInArrow(_forest, "u long, v long"), "forest", held)
    seen = None
    for _ in range(rounds):
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(at) == seen or not at[0]:
            break
        seen = tuple(at)
        # a round has about as many rows as the one before, so few rows need few files
        before, held = held, []
        now = written(_small(_large(now)).coalesce(ceil(at[0] / FILE_ROWS)), "stars", held)
        remove(spark, before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if scratch is not None:
        scratch += held
    heads = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads) if at[0] else spark.createDataFrame([], "node long, component long")


def grouped(batches, keys: int):
    """Tables of consecutive rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(cut)
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
