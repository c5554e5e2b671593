"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

Signatures (Ertl 2017).  Every shingle draws, level by level, a rank and a
slot of its own random permutation; a slot keeps the smallest level-and-rank it
sees.  As slots are dealt without replacement the signature has a lower variance
than independent minima, and a text stops as soon as no later level can lower
any of its slots.

Candidates.  Texts with equal shingle sets form a class, represented by its
smallest id.  Representatives are banded; b bands of r slots are chosen so that
a pair exactly at the threshold is missed with a probability of at most
``MISS``.  In every bucket all members are first compared with one centre, the
member whose buckets are largest; what is joined so is contracted.  Then all
pairs of a bucket that still lie in different components are compared in blocks
of bounded size: the bucket's largest component against all that lies outside
it, and the latter among itself.  So many near copies beside a few strays are
copied once for each block of strays, not once for each block of the bucket.
Pairs are looked at first by signature (a bound ``SIGMAS`` deviations below the
threshold) and then by full sets.  No link between different texts is left out
but by those two stated probabilities, and no bucket is ever expanded into all
its pairs.  Links are confirmed on the full shingle sets, read from the texts.

Equal texts are one row in all of this; rows join their class at the end, by a
join that adaptive execution can split where a class has very many copies.
"""

from __future__ import annotations

from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.components import components, grouped
from ..sources.tables import remove, written
from . import vec

MISS = 1e-6
SIGMAS = 6
#: Shingles held by a block of a bucket's members, about; a task holds two blocks.
BLOCK = 1 << 19
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
_LAZY = 6


def bands_for(threshold: float, slots: int = 256) -> tuple[int, int]:
    """(bands, rows): most rows for which pairs at the threshold are missed with at most MISS."""
    for r in range(12, 0, -1):
        b = ceil(log(MISS) / log(1 - threshold**r))
        if b * r <= slots:
            return b, r
    raise ValueError(f"threshold {threshold} is too low for {slots} slots")


def superminhash(doc: np.ndarray, h: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) signatures of the distinct (doc, h); rows without elements keep the largest value."""
    sig = np.full((rows, m), np.iinfo(np.uint64).max, dtype=U64)
    flat = sig.reshape(-1)
    at = doc * m
    swaps: list[np.ndarray] = []
    puts: list[np.ndarray] = []
    table = None
    for j in range(m):
        if not len(h):
            break
        z = vec.mix(h + U64((j + 1) * int(GOLD) % (1 << 64)))
        k = U64(j) + (((vec.mix(z + GOLD) >> U64(32)) * U64(m - j)) >> U64(32))
        k = k.astype(np.int64)
        if j < _LAZY:
            here, there = np.full(len(h), j, dtype=np.int64), k.copy()
            for s, p in zip(swaps, puts, strict=True):
                here = np.where(s == j, p, here)
                there = np.where(s == k, p, there)
            swaps.append(k)
            puts.append(here)
        else:
            every = np.arange(len(h))
            if table is None:
                table = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
                for s, p in zip(swaps, puts, strict=True):
                    table[every, s] = p
            there = table[every, k].astype(np.int64)
            table[every, k] = table[:, j]
        np.minimum.at(flat, at + there, (U64(j) << U64(56)) | (z >> U64(8)))
        open_docs = sig.max(axis=1) >= (U64(j + 1) << U64(56))
        keep = open_docs[at // m]
        if not keep.all():
            h, at = h[keep], at[keep]
            swaps, puts = [x[keep] for x in swaps], [x[keep] for x in puts]
            table = table[keep] if table is not None else None
    return sig


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signer(k: int, bands: int, rows: int):
    m = bands * rows

    def sign(batches):
        for batch in batches:
            for s in vec.slices(batch.column(1)):
                n = s.last - s.first
                doc, h, bounds = vec.distinct(*vec.shingles(s, k), n)
                sizes = np.diff(bounds)
                total = np.concatenate([[U64(0)], np.cumsum(vec.mix(h + U64(7)))])
                mixed = np.concatenate([[U64(0)], np.bitwise_xor.accumulate(vec.mix(h ^ U64(0x5DEECE66D)))]) if len(h) else np.zeros(1, U64)
                sig = superminhash(doc, h, n, m)
                keys = np.zeros((n, bands), dtype=U64)
                for i in range(rows):
                    keys = vec.mix(keys * U64(vec.STEP) + sig[:, i::rows][:, :bands])
                keys = vec.mix(keys + np.arange(1, bands + 1, dtype=U64) * GOLD)
                some = sizes > 0
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), _long(keys[some].reshape(-1)))
                low = (vec.mix(sig) & U64(255)).astype(np.uint8)
                short = pa.array([bytes(x) for x in low], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, n), pa.array(sizes), _long(total[bounds[1:]] - total[bounds[:-1]]), _long(mixed[bounds[1:]] ^ mixed[bounds[:-1]]), listed, short],
                    names=["id", "n", "set_a", "set_b", "bands", "sig"],
                )

    return sign


def _verifier(k: int, num: int, den: int):
    def sets(column):
        for s in vec.slices(column):
            _, h, bounds = vec.distinct(*vec.shingles(s, k), s.last - s.first)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield h[a:b]

    def verify(batches):
        for batch in batches:
            linked = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return verify


def _sets(k: int):
    def make(batches):
        for batch in batches:
            for s in vec.slices(batch.column(1)):
                _, h, bounds = vec.distinct(*vec.shingles(s, k), s.last - s.first)
                held = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.last - s.first), pa.array(held, pa.binary())], names=["id", "shingles"])

    return make


def _blocks(threshold: float, m: int, num: int, den: int):
    """Links between the two sides of a block, or within it where both sides are one, of members in different components.

    A pair is looked at in the first bucket that it shares.  What is linked here is
    one component from then on, so few more links are found than needed.
    """
    cut = m * (threshold - SIGMAS * sqrt(threshold * (1 - threshold) / m))

    def emit(batches):
        for t in grouped(batches, 3):
            if len(t) < 2:
                continue
            ids, n, comp, own = (t.column(c).to_numpy() for c in ("id", "n", "comp", "block"))
            comp = np.unique(comp, return_inverse=True)[1]
            bucket, x, y = (t.column(c)[0].as_py() for c in ("bucket", "bi", "bj"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(t), m)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            band = int(np.flatnonzero(bands[0] == bucket)[0])
            sets = [np.frombuffer(v, dtype=U64) for v in t.column("shingles").to_pylist()]
            left, right = [], []
            for i in np.flatnonzero(own == y):  # the side outside the largest component
                ok = (comp != comp[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & (own == x)
                if x == y:
                    ok[: i + 1] = False
                ok = np.flatnonzero(ok)
                ok = ok[(sig[ok] == sig[i]).sum(axis=1) >= cut]
                ok = ok[(bands[ok] == bands[i]).argmax(axis=1) == band]
                for j in ok:
                    if comp[i] != comp[j]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if den * both >= num * (int(n[i]) + int(n[j]) - both):
                            comp[comp == comp[j]] = comp[i]
                            left.append(ids[i])
                            right.append(ids[j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return emit


def _dealt(placed: DataFrame) -> DataFrame:
    """(bucket, bi, bj, rep, n, comp, block) of the members of buckets that hold several components.

    Blocks of the largest component (by shingles) have numbers below 0, blocks of the
    rest from 0.  A block of the largest meets every block of the rest, and
    blocks of the rest meet each other; bi <= bj.
    """
    held = placed.groupBy("bucket", "comp").agg(F.sum("n").alias("held"))
    sides = held.groupBy("bucket").agg(F.max(F.struct("held", "comp")).alias("most"), F.sum("held").alias("whole"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sides = sides.select("bucket", F.col("most.comp").alias("main"), blocks(F.col("most.held")).alias("mains"), blocks(F.col("whole") - F.col("most.held")).alias("rests"))
    df = placed.join(sides, "bucket").withColumn("inside", F.col("comp") == F.col("main"))
    number = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    df = df.withColumn("block", F.when(F.col("inside"), -1 - number(F.col("mains"))).otherwise(number(F.col("rests"))))
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    df = df.withColumn("other", F.explode(F.when(F.col("inside"), rests).otherwise(F.concat(F.sequence(-F.col("mains"), F.lit(-1)), rests))))
    return df.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "n", "comp", "block")


def _groups(base: DataFrame, signed: DataFrame, k: int, num: int, den: int, bands: int, rows: int, scratch: list[str]) -> DataFrame:
    """(set_a, set_b, n, group) for the classes of equal sets that are linked with another one; group is the smallest representative."""
    classes = signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).where("rep is not null")
    dealt = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(dealt.join(full, "bucket"), "shared", scratch)

    wanted = shared.select(F.col("rep").alias("id")).distinct()
    texts = written(base.join(wanted, "id", "left_semi"), "texts", scratch)

    degree = shared.groupBy("rep").agg(F.sum("members").alias("degree"))
    ranked = shared.join(degree, "rep")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"), "n")).alias("c"))
    centre = centre.select("bucket", (-F.col("c.least")).alias("centre"), F.col("c.n").alias("centre_n"))
    near = F.least("n", "centre_n") * den >= F.greatest("n", "centre_n") * num
    spokes = shared.join(centre, "bucket").where((F.col("rep") != F.col("centre")) & near)
    pairs = spokes.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    first = written(both.select("a", "b", "text_a", "text_b").mapInArrow(vec.tidy(_verifier(k, num, den)), "a long, b long"), "spokes", scratch)

    some = components(first, "a", "b", scratch=scratch)
    placed = shared.join(some.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).select("bucket", "rep", "n", "comp")
    left = written(_dealt(placed), "left", scratch)
    open_reps = left.select(F.col("rep").alias("id")).distinct()
    sets = texts.join(open_reps, "id", "left_semi").select("id", "text").mapInArrow(vec.tidy(_sets(k)), "id long, shingles binary")
    sets = sets.join(classes.select(F.col("rep").alias("id"), F.col("n").alias("set_n"), "sig", "bands"), "id").where(F.length("shingles") == 8 * F.col("set_n")).withColumnRenamed("id", "rep")
    left = left.join(sets, "rep").where("n = set_n").select("bucket", "bi", "bj", F.col("rep").alias("id"), "n", "comp", "block", "sig", "bands", "shingles")
    left = left.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    second = written(left.mapInArrow(vec.tidy(_blocks(num / den, bands * rows, num, den)), "a long, b long"), "rest", scratch)

    whole = components(first.union(second), "a", "b", scratch=scratch).withColumnRenamed("node", "rep")
    return classes.select("set_a", "set_b", "n", "rep").join(whole, "rep").select("set_a", "set_b", "n", F.col("component").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two texts are linked if den * |A & B| >= num * |A | B| for their sets of
    k-word shingles.  Ids are integers; a column of another type is refused.  Null or
    empty texts and texts without words have an empty set and are linked with
    nothing.  Very long texts are read whole, one slice of a batch each.  Rows
    that share an id are grouped each by its
    own text; classes with the same smallest id are one node.  A row with a null
    id joins the group of its equals (component null if all of these have null
    ids).  An empty table gives no rows; other columns of docs, whatever their
    names, are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds no integers: a group is named by its smallest id")
    spark, scratch = docs.sparkSession, []
    bands, rows = bands_for(num / den)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(base.mapInArrow(vec.tidy(_signer(k, bands, rows)), "id long, n long, set_a long, set_b long, bands array<long>, sig binary"), "signed")

    # the smallest id of every class that has several rows or is linked, as a table of its own: only the rows' side of the join can be large under one key
    classes = signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    linked = _groups(base, signed, k, num, den, bands, rows, scratch)
    groups = classes.join(linked, ["set_a", "set_b", "n"], "left").where("copies > 1 or group is not null")
    groups = written(groups.select("set_a", "set_b", "n", F.coalesce("group", "rep").alias("group")), "groups")
    remove(spark, scratch)
    some = signed.where("n > 0").select("id", "n", "set_a", "set_b").join(groups, ["set_a", "set_b", "n"], "left").select("id", "n", "group")
    out = some.union(signed.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("group")))
    component = F.coalesce("group", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose group has a smaller id; rows that share a kept id all stay.

    All columns stay, whatever their names.  Nulls, empty and very long texts,
    repeated rows and empty tables: see ``near_duplicates``.
    """
    groups = near_duplicates(docs, id_col, **options).where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    return docs.alias("d").join(groups.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.kept_id")), "left_semi")
