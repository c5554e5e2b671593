"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or abstain on every text.  The counts of all
vote patterns over the whole corpus (a table bounded by the labellers) go to
expectation-maximisation, which estimates each labeller's accuracies and the
posterior of every pattern without any gold label.  The posteriors of a bounded
sample of texts, TRAIN_ROWS by a hash of the text and TRAIN_BYTES in all, train a linear scorer
on hashed features (3-grams of byte classes and word-level ratios), which scores
all texts.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

TRAIN_ROWS = 3000
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 12
KEEP_AT = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "symbol_ends", "capitals", "exclamations", "pipes", "lone_marks", "repeats", "few_words", "prose", "sentences")

_CLASS = np.full(256, 13, dtype=np.uint8)
for _bytes, _class in (
    (b"abcdefghijklmnopqrstuvwxyz", 0),
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1),
    (b"0123456789", 2),
    (b" ", 3),
    (b"\n", 4),
    (b".", 5),
    (b",", 6),
    (b"!?", 7),
    (b"|", 8),
    (b"%", 9),
    (b"*", 10),
    (b"#", 11),
    (b"&$", 12),
    (bytes(range(0xC0, 0x100)), 14),
    (bytes([*range(0x80, 0xC0), *range(0x20), 0x7F]).replace(b"\n", b""), 15),
):
    _CLASS[np.frombuffer(_bytes, dtype=np.uint8)] = _class


class Facts:
    """Counts of a slice's texts from which labellers vote and features are hashed."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, s: vec.Slice):
        self.rows = rows = s.last - s.first
        begin = offsets[s.first : s.last + 1] - s.base
        self.classes = _CLASS[raw[s.base : s.base + begin[-1]]]
        self.doc = np.repeat(np.arange(rows), np.diff(begin))
        self.counts = np.bincount(self.doc * 16 + self.classes, minlength=rows * 16).reshape(rows, 16).astype(np.float64)
        self.bytes = np.maximum(self.counts.sum(axis=1), 1)
        self.words = np.bincount(s.doc, minlength=rows).astype(np.float64)
        per = np.maximum(self.words, 1)
        last = self.classes[s.end - 1]
        share = lambda which: np.bincount(s.doc[which], minlength=rows) / per
        self.symbol_ends = share((last >= 9) & (last <= 12))
        self.lone = share((s.end - s.begin == 1) & (last >= 5) & (last <= 13))
        again = np.zeros(len(s.words), dtype=bool)
        again[1:] = (s.words[1:] == s.words[:-1]) & (s.doc[1:] == s.doc[:-1])
        self.repeats = share(again)
        _, _, bounds = vec.distinct(s.doc, s.words, rows)
        self.distinct = np.diff(bounds) / per
        self.symbols = self.counts[:, 9:13].sum(axis=1) / self.bytes
        self.capitals = self.counts[:, 1] / np.maximum(self.counts[:, 0] + self.counts[:, 1], 1)
        self.exclaimed, self.pipes = self.counts[:, 7] / per, self.counts[:, 8] / per
        self.stops = (self.counts[:, 5] + self.counts[:, 6]) / per

    def votes(self) -> np.ndarray:
        """(rows, labellers)"""
        w = self.words
        bad = [
            self.symbols > 0.04,
            (self.symbol_ends > 0.2) & (w >= 3),
            (self.capitals > 0.5) & (self.counts[:, :2].sum(axis=1) >= 8),
            (self.exclaimed > 0.3) & (w >= 3),
            (self.pipes > 0.1) & (w >= 3),
            (self.lone > 0.2) & (w >= 5),
            (self.repeats > 0.15) & (w >= 6),
            (self.distinct < 0.35) & (w >= 20),
        ]
        calm = (self.symbols == 0) & (self.pipes == 0) & (self.repeats < 0.05) & (self.capitals < 0.25)
        good = [calm & (w >= 1), (self.stops > 0.02) & (self.stops < 0.5) & (self.exclaimed < 0.05) & (w >= 5)]
        return np.stack([*(np.where(x, BAD, ABSTAIN) for x in bad), *(np.where(x, GOOD, ABSTAIN) for x in good)], axis=1)

    def features(self) -> np.ndarray:
        """(rows, BUCKETS) of float32; each row's 3-gram shares, and its ratios in hashed bins."""
        out = np.zeros((self.rows, BUCKETS), dtype=np.float32)
        c = self.classes.astype(np.int64)
        if len(c) >= 3:
            same = self.doc[2:] == self.doc[:-2]
            gram = (c[:-2] * 256 + c[1:-1] * 16 + c[2:])[same]
            at = self.doc[:-2][same] * BUCKETS + (vec.mix(gram.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)
            out += np.bincount(at, minlength=self.rows * BUCKETS).reshape(out.shape) * (8 / self.bytes)[:, None]
        every = np.arange(self.rows)
        ratios = (self.repeats, self.distinct, self.capitals, self.symbols * 4, self.exclaimed, self.pipes, self.symbol_ends, self.lone)
        for i, ratio in enumerate(ratios):
            bins = np.minimum(ratio * 10, 10).astype(np.uint64) + np.uint64(100_000 + 100 * i)
            out[every, (vec.mix(bins) & np.uint64(BUCKETS - 1)).astype(np.int64)] += 1
        out[:, 0] = 1
        return out


def facts(column: pa.Array, limit: int = 1 << 18):
    """The facts of a text column, slice by slice."""
    raw, offsets = vec.buffers(column)
    for s in vec.slices(column, limit):
        for first in range(s.first, s.last, 512):  # short texts: bounded rows too
            last = min(s.last, first + 512)
            if first == s.first and last == s.last:
                yield s.first, s.last, Facts(raw, offsets, s)
            else:
                own = (s.doc >= first - s.first) & (s.doc < last - s.first)
                base = int(offsets[first])
                shift = base - s.base
                yield first, last, Facts(raw, offsets, vec.Slice(first, last, s.words[own], s.doc[own] - (first - s.first), s.begin[own] - shift, s.end[own] - shift, base))


def pack(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) of each labeller, share of good) by expectation-maximisation.

    It starts from the majority of the votes that are not abstentions; a tie counts as good.
    """
    votes, n = unpack(patterns), counts.astype(np.float64)
    good = ((votes == GOOD).sum(axis=1) >= (votes == BAD).sum(axis=1)).astype(np.float64) * 0.98 + 0.01
    for _ in range(rounds):
        prior = float(np.clip((good * n).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3))
        table = np.empty((2, len(LABELLERS), 3))
        for y, weight in enumerate(((1 - good) * n, good * n)):
            for v in range(3):
                table[y, :, v] = ((votes == v) * weight[:, None]).sum(axis=0) + 0.01
            table[y] /= table[y].sum(axis=1, keepdims=True)
        each = np.log(table[:, np.arange(len(LABELLERS)), votes]).sum(axis=2)
        new = 1 / (1 + np.exp(np.clip(each[0] - each[1] + log((1 - prior) / prior), -30, 30)))
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return good, table, prior


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, by full-batch AdaGrad."""
    w, seen = np.zeros(x.shape[1], dtype=np.float32), np.full(x.shape[1], 1e-6, dtype=np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / len(y) + ridge * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def _votes(batches):
    for batch in batches:
        for _, _, f in facts(batch.column(0)):
            found, n = np.unique(pack(f.votes()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])


class Scorer:
    """What the executors need: posteriors of the patterns and the scorer's weights."""

    def __init__(self, patterns: np.ndarray, posterior: np.ndarray, weights: np.ndarray):
        self.posterior = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
        self.weights = weights

    def rows(self, column: pa.Array):
        """(first, last, patterns, posteriors, scores)"""
        for first, last, f in facts(column):
            patterns = pack(f.votes())
            scores = 1 / (1 + np.exp(-np.clip((f.features() @ self.weights).astype(np.float64), -30, 30)))
            yield first, last, patterns, np.array([self.posterior.get(p, 0.5) for p in patterns.tolist()]), scores


def fit(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> Scorer:
    """The weak-label model of all texts of docs and a scorer trained on at most ``rows`` of them."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    held = texts.mapInArrow(vec.tidy(_votes), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r.pattern for r in held], dtype=np.int64), np.array([r.n for r in held], dtype=np.int64)
    if not len(patterns):
        return Scorer(patterns, np.zeros(0), np.zeros(BUCKETS, dtype=np.float32))
    good, _, _ = estimate(patterns, counts)
    known = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    # the smallest hashes among all texts; whole texts are fetched for these alone
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    hashed = texts.where(size <= TRAIN_BYTES).select("text", F.xxhash64("text").alias("h"))
    sizes = hashed.groupBy("h").agg(F.max(size).alias("n")).orderBy("h").limit(rows).collect()
    if not sizes:
        return Scorer(patterns, good, np.zeros(BUCKETS, dtype=np.float32))
    fits = int(np.searchsorted(np.cumsum([r.n for r in sizes]), TRAIN_BYTES, side="right"))
    top = sizes[fits - 1].h
    picked = [r.text for r in hashed.where(F.col("h") <= top).dropDuplicates(["h"]).select("text").collect()]
    x, y = [], []
    for _, _, f in facts(pa.array(picked, pa.large_string())):
        x.append(f.features())
        y += [known[p] for p in pack(f.votes()).tolist()]
    return Scorer(patterns, good, train(np.concatenate(x), np.array(y)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, at: float = KEEP_AT) -> DataFrame:
    """(id, votes, posterior, score, predicted) for every row of docs; score is the probability of good text.

    A null text counts as empty; repeated rows score alike.  Very long texts are scored
    whole, but none beyond TRAIN_BYTES trains the scorer.  An empty table gives no rows; other
    columns, whatever their names, are not read.  votes is a number
    of base 3 with a digit for each labeller.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, rows))  # bounded by buckets and labellers

    def score(batches):
        for batch in batches:
            for first, last, patterns, posterior, scores in sent.value.rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(patterns), pa.array(posterior), pa.array(scores)], names=["id", "votes", "posterior", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(vec.tidy(score), f"id {kind}, votes long, posterior double, score double")
    return scored.select(F.col("id").alias(id_col), "votes", "posterior", "score", (F.col("score") >= at).cast("int").alias("predicted"))


def accepted(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS, at: float = KEEP_AT) -> DataFrame:
    """docs without the rows that score below ``at``; all columns stay, whatever their names.

    Nulls, repeated rows, very long texts and empty tables: as in ``quality``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, rows))
    column = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for first, last, _, _, scores in sent.value.rows(batch.column(column)):
                yield batch.slice(first, last - first).filter(pa.array(scores >= at))

    return docs.mapInArrow(vec.tidy(keep), docs.schema)
