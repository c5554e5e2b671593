"""Benchmark decontamination by greedy string tiling.

A benchmark item's windows of K words are the seeds (an item of fewer words is one
seed).  A document's windows are hashed by a rolling polynomial (Karp-Rabin) where
they lie; those that a Bloom filter of the seeds lets pass are joined with the
seeds by hash.  The seeds that a document and an item share then meet: those on
one diagonal run together into maximal matches, and tiling marks the
longest match whose words are unmarked on both sides, again and again, until no
match of K words is left.  An item is leaked by a document if its marked words are
at least ``coverage`` of it, in whatever order the passages stand.

Documents are read in one pass, whatever the benchmark's size; only windows that
pass the filter travel, not texts.  The filter has BLOOM_BITS bits and is built by an
aggregation over the seeds, so neither the driver nor a broadcast grows with the
benchmark.  The join is by the seed's hash, so a passage in very many documents is one
key of it, which adaptive execution splits; what meets afterwards is one document and one item.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import grouped
from ..sources.tables import written
from . import vec

K = 5
COVERAGE = 0.6
BLOOM_BITS = 26
_WINDOW = "g1 long, g2 long, length int, h long, at long"
_SEED = "i1 long, i2 long, size long, length int, h long, pos long"


def _windows(batch: pa.RecordBatch, lengths, passes=None):
    """(text, words of the text, length, hash, place) of the windows in a batch whose third column is text, slice by slice."""
    for s in vec.slices(batch.column(2)):
        bounds = s.bounds()
        sizes = np.diff(bounds)
        for length in lengths:
            h = vec.grams(s.words, length)
            at = np.arange(len(h)) if passes is None else np.flatnonzero(passes(h))
            at = at[s.doc[at] == s.doc[at + length - 1]]
            row = s.doc[at]
            yield s.first + row, sizes[row], length, h[at], at - bounds[row]


def _seeds(k: int):
    """Seeds of items (i1, i2, text): all windows of k words, or the whole item where it has fewer."""

    def make(batches):
        for batch in batches:
            for row, size, length, h, pos in _windows(batch, range(1, k + 1)):
                own = size == length if length < k else size >= k
                row, size, h, pos = row[own], size[own], h[own], pos[own]
                columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size), pa.array(np.full(len(row), length, dtype=np.int32)), vec.signed(h), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(columns, names=["i1", "i2", "size", "length", "h", "pos"])

    return make


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - BLOOM_BITS), (h >> np.uint64(64 - 2 * BLOOM_BITS)) & np.uint64((1 << BLOOM_BITS) - 1)


def _bloom(seeds: DataFrame) -> tuple[list[int], np.ndarray]:
    """The seeds' lengths, and the filter as words of 64 bits: 2**BLOOM_BITS / 64 rows at most, whatever the number of seeds."""
    high, low = F.shiftrightunsigned("h", 64 - BLOOM_BITS), F.shiftrightunsigned("h", 64 - 2 * BLOOM_BITS).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
    bits = seeds.select(F.explode(F.array(high, low)).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return sorted(r.length for r in seeds.select("length").distinct().collect()), out


def tile(pos: np.ndarray, at: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item begin, text begin, words) from seeds at (pos, at) of k words."""
    diagonal = at - pos
    order = np.lexsort((pos, diagonal))
    pos, at, diagonal = pos[order], at[order], diagonal[order]
    cut = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(pos) != 1)) + 1
    runs = [(-(int(b - a) + k - 1), int(at[a]), int(pos[a])) for a, b in zip([0, *cut], [*cut, len(pos)], strict=True)]
    heapq.heapify(runs)
    low = int(at.min())
    item, text = np.zeros(size, dtype=bool), np.zeros(int(at.max()) + k - low, dtype=bool)
    tiles = []
    while runs:
        n, t, i = heapq.heappop(runs)
        n = -n
        taken = item[i : i + n] | text[t - low : t - low + n]
        if not taken.any():
            item[i : i + n] = True
            text[t - low : t - low + n] = True
            tiles.append((i, t, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= k:
                heapq.heappush(runs, (-int(b - a), t + int(a), i + int(a)))
    return tiles


def _tiled(k: int, coverage: float):
    """Items leaked by documents, from sorted rows (g1, g2, i1, i2, size, pos, at)."""

    def run(batches):
        found = []
        for t in grouped(batches, 4):
            size = t.column("size")[0].as_py()
            length = min(k, size)
            places = np.unique(np.stack([t.column("at").to_numpy(), t.column("pos").to_numpy()], axis=1), axis=0)
            at, pos = places[:, 0], places[:, 1]
            held = np.zeros(size + 1, dtype=np.int64)
            np.add.at(held, pos, 1)
            np.add.at(held, pos + length, -1)
            if (np.cumsum(held)[:size] > 0).sum() < coverage * size:  # what tiling can mark at most
                continue
            tiles = tile(pos, at, length, size)
            marked = sum(n for _, _, n in tiles)
            if marked >= coverage * size:
                found.append((*(t.column(c)[0].as_py() for c in ("g1", "g2", "i1", "i2")), marked / size, marked, size, len(tiles)))
        if found:
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 3
            names = ["g1", "g2", "i1", "i2", "coverage", "words_marked", "words", "tiles"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str, first: str, second: str) -> DataFrame:
    """(id, first, second, text): two hashes that stand for the id and the text of a row."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.select("id", F.xxhash64("text", "id").alias(first), F.xxhash64(F.lit(1), "id").alias(second), "text")


def _leaks(docs: DataFrame, items: DataFrame, k: int, coverage: float) -> DataFrame:
    """(g1, g2, i1, i2, coverage, words_marked, words, tiles) from keyed documents and items."""
    seeds = items.select("i1", "i2", "text").mapInArrow(vec.tidy(_seeds(k)), _SEED).distinct()
    lengths, bloom = _bloom(seeds)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)  # 2**BLOOM_BITS / 8 bytes

    def scan(batches):
        bits = sent.value

        def passes(h):
            ok = np.ones(len(h), dtype=bool)
            for bit in _probes(h):
                ok &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            return ok

        for batch in batches:
            for row, _, length, h, at in _windows(batch, lengths, passes):
                if len(row):
                    columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.full(len(row), length, dtype=np.int32)), vec.signed(h), pa.array(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=["g1", "g2", "length", "h", "at"])

    hits = docs.select("g1", "g2", "text").mapInArrow(vec.tidy(scan), _WINDOW)
    both = hits.join(seeds, ["h", "length"]).select("g1", "g2", "i1", "i2", "size", "pos", "at")
    dealt = both.repartition("g1", "g2", "i1", "i2").sortWithinPartitions("g1", "g2", "i1", "i2")
    found = dealt.mapInArrow(vec.tidy(_tiled(k, coverage)), "g1 long, g2 long, i1 long, i2 long, coverage double, words_marked long, words long, tiles long")
    # as a table its size is known, so few leaks are broadcast and the documents are not shuffled to be joined with them
    return written(found, "leaks")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """(id, item, coverage, words_marked, words, tiles) for every document and item it leaks.

    Words are lower-cased and parted by white space.  An item of fewer than k
    words must stand whole.  Null or empty texts and items leak nothing; very long texts are
    read whole.  Ids keep their type and may be null.  Repeated
    documents give repeated results, repeated items none; an empty table on either side gives no
    rows.  Other columns, whatever their names, are not read.
    """
    rows, items = _keyed(docs, id_col, text_col, "g1", "g2"), _keyed(bench, item_col, item_text, "i1", "i2")
    found = _leaks(rows, items, k, coverage)
    named = found.join(items.select("i1", "i2", F.col("id").alias("item")).distinct(), ["i1", "i2"])
    out = rows.select("g1", "g2", "id").join(named, ["g1", "g2"])
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "words_marked", "words", "tiles")


def without_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that leak an item; all columns stay, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables: as in ``contaminated``.
    """
    found = _leaks(_keyed(docs, id_col, text_col, "g1", "g2"), _keyed(bench, item_col, item_text, "i1", "i2"), k, coverage)
    told = found.select("g1", "g2").distinct().alias("f")
    d = docs.alias("d")
    text, own = F.col(f"d.{text_col}").cast("string"), F.col(f"d.{id_col}")
    return d.join(told, (F.xxhash64(text, own) == F.col("f.g1")) & (F.xxhash64(F.lit(1), own) == F.col("f.g2")), "left_anti")
