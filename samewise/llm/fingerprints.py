"""Order MinHash fingerprints (Marcais et al. 2019) of texts.

A text's elements are its k-mers of K bytes that begin at a code point, each
numbered by its occurrence in the text.  For each of SIZE orders the two
smallest of all elements are taken, put back into text order and hashed as a pair, so
the part of equal components follows edit distance, not only shared content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import IntegralType

from . import vec

K = 8
SIZE = 64
U64 = np.uint64
_MAX = U64(np.iinfo(np.uint64).max)
_HIGH, _LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)
_rng = np.random.default_rng(6)
_ODD = _rng.integers(0, 1 << 63, SIZE, dtype=U64) * U64(2) + U64(1)


def _occurrences(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each row's k-mer has occurred before it in its text."""
    key = vec.mix(h + doc.astype(U64) * U64(vec.STEP))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    out = np.zeros(len(h), dtype=U64)
    if len(again):
        seen = np.zeros(1 << 16, dtype=bool)
        seen[again & U64(0xFFFF)] = True
        some = np.flatnonzero(seen[key & U64(0xFFFF)])
        order = np.argsort(key[some], kind="stable")
        k = key[some][order]
        start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        out[some[order]] = np.arange(len(k)) - np.repeat(start, np.diff(np.concatenate([start, [len(k)]])))
    return out


def _sketch(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SIZE) components of 16 bits; an empty text has zeros."""
    n, rows = len(raw), len(offsets) - 1
    out = np.zeros((rows, SIZE), dtype=np.uint16)
    if not n:
        return out
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * vec.powers(vec.BASE, n), out=total[1:])
    doc_of = np.repeat(np.arange(rows), np.diff(offsets))
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = begin[begin + K <= offsets[doc_of[begin] + 1]]
    short = offsets[:-1][(np.diff(offsets) > 0) & (np.diff(offsets) < K)]
    begin = np.sort(np.concatenate([whole, short])) if len(short) else whole
    doc = doc_of[begin]
    end = np.minimum(begin + K, offsets[doc + 1])
    h = vec.mix((total[end] - total[begin]) * vec.powers(vec.BASE_INV, n)[begin])
    if not len(h):
        return out
    e = vec.mix(h + _occurrences(h, doc) * U64(0xC2B2AE3D27D4EB4F))
    starts = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    some = doc[starts]
    # the upper half of an element's rank, then its place in its own text: no other text has a say in the order
    place = np.arange(len(h), dtype=U64) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]]))).astype(U64)
    v = np.empty(len(h), dtype=U64)
    for p in range(SIZE):
        np.multiply(e, _ODD[p], out=v)
        v &= _HIGH
        v |= place
        first = (np.minimum.reduceat(v, starts) & _LOW).astype(np.int64) + starts
        v[first] = _MAX
        second = np.minimum.reduceat(v, starts)
        alone = second == _MAX
        second = np.where(alone, first, (second & _LOW).astype(np.int64) + starts)
        a, b = e[np.minimum(first, second)], e[np.maximum(first, second)]
        out[some, p] = (vec.mix(a * U64(vec.STEP) + np.where(alone, U64(0), b) + U64(p)) >> U64(48)).astype(np.uint16)
    return out


def sketches(texts: list[bytes]) -> np.ndarray:
    """Components of every text, worked off in slices."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    out, i = [np.zeros((0, SIZE), dtype=np.uint16)], 0
    while i < len(texts):
        j, held = i + 1, sizes[i]
        while j < len(texts) and held + sizes[j] <= vec.SLICE_BYTES:
            held += sizes[j]
            j += 1
        out.append(_sketch(np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes[i:j])])))
        i = j
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of equal components, row by row."""
    return (a == b).mean(axis=1)


def _hex(x: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in x]


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _neighbours(batches):
    """Fingerprints of sorted rows (id, text, order, place); rows of place 1 only follow the last of place 0."""
    held: tuple | None = None
    closed = False

    def rows(ids, texts, last):
        """All but the last row are done; texts has one more than ids."""
        plain = [t.encode() for t in texts]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        more = [t.encode() for t in changed]
        own, new = sketches(plain), sketches(more)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in more]),
                pa.array(_hex(own[:-1])),
                pa.array(_hex(new)),
                pa.array(likeness(own[:-1], new)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        if closed:
            continue
        size = 256
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            ids, texts, place = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_numpy()
            ends = int((place == 0).sum())
            if held is not None:
                ids, texts, ends = [held[0], *ids], [held[1], *texts], ends + 1
            if ends < len(ids):  # the next partition's first row is here
                if ends:
                    yield rows(ids[:ends], texts[: ends + 1], True)
                held, closed = None, True
                break
            if len(ids) > 1:
                yield rows(ids[:-1], texts, False)
            held = (ids[-1], texts[-1])
    if held is not None:
        raise RuntimeError("a partition has no row that follows its last one")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    Ids are integers; a column of another type is refused.  Rows are ordered by
    id, then by a hash of the text; null ids come first and
    a null text counts as empty.  The row after the last is the first, so a lone row follows
    itself; an empty table gives no rows.  Empty texts are alike; a very long text is a slice of its own.
    Repeated rows follow each other.  The rows are dealt once, by ranges of id, and of the text's hash within an id of very many rows;
    the first row of a range also goes to the range before it.  The driver sees
    one id for each partition.  Other columns, whatever their names, are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds no integers: rows are ordered by it")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("order", F.xxhash64("text"))
    known = F.coalesce("id", F.lit(-(1 << 63)))
    found = base.select(F.percentile_approx(known, [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    cuts = np.sort(np.array(found or [], dtype=np.int64))

    @pandas_udf("int")
    def bucket(ids, orders):
        low, high = (np.searchsorted(cuts, ids.to_numpy(), side=side) for side in ("left", "right"))
        within = (orders.to_numpy() / 2.0**64 + 0.5).clip(0, 1 - 1e-9)  # an id that is several cuts has several ranges
        return pd.Series((low + np.floor(within * (high - low))).astype(np.int32))

    dealt = base.withColumn("bucket", bucket(known, F.col("order")))
    low = F.struct(F.col("id").isNotNull().alias("some"), F.coalesce("id", F.lit(0)).alias("id"), "order")
    heads = sorted((r.bucket, tuple(r.head)) for r in dealt.groupBy("bucket").agg(F.min(low).alias("head")).collect())
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    first = spark.createDataFrame([(b, i if some else None, o, before[b]) for b, (some, i, o) in heads], "at int, head long, head_order long, earlier int")
    same = (F.col("bucket") == F.col("at")) & F.col("id").eqNullSafe(F.col("head")) & (F.col("order") == F.col("head_order"))
    dealt = dealt.join(F.broadcast(first), same, "left")  # a row for each partition
    targets = F.filter(F.array(F.col("bucket"), F.col("earlier")), lambda x: x.isNotNull())
    sent = dealt.select("id", "text", "order", F.posexplode(targets).alias("place", "target"))
    sent = sent.repartitionById(max(parts, 1), F.col("target")).sortWithinPartitions("place", F.col("id").asc_nulls_first(), "order").select("id", "text", "order", "place")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_neighbours, schema).withColumnRenamed("id", id_col)
