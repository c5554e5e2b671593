"""Toxicity by compression distance.

The ordinary zstandard dictionary is trained on windows of ordinary text.  The
toxic one holds, besides, what recurs in toxic text in many different contexts
and hardly in ordinary text (contexts are counted, not occurrences, so copies of
one text add nothing).  A dictionary that zstandard itself trains on windows of toxic
text holds mostly ordinary language: scores from such a pair have an area under the
curve of 0.58 (sf0.1) to 0.64 (check_s) on held-out rows, and hardly a score reaches 0.7.  A window that is shorter under the toxic dictionary
speaks for toxicity.  Matches under MIN_MATCH bytes are not used, so pieces of
words gain nothing.  The gains of all windows are summed up in a few features,
whose logistic weights (the calibrated thresholds on compression lengths) are
fitted on labelled texts kept out of the dictionaries.

The model is fitted on a bounded sample of labelled rows, TRAIN_ROWS and
TRAIN_BYTES for each class, taken by a hash of the id; its size does not grow with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 3000
TRAIN_BYTES = 32 << 20
WINDOW = 256
BASE_BYTES = 32768
MIN_MATCH = 6
RATIO = 20.0
CONTEXTS = 8
PREDICT_AT = 0.7
_EDGES = ".,;:!?\"'()"


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole lower-cased text in windows of about ``size`` bytes that end between words if they can."""
    data = (text or "").lower().encode()
    found, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + size)
        if end < 0 or end > at + 2 * size:
            end = min(len(data), at + 2 * size)
        found.append(b" " + data[at:end].strip() + b" ")
        at = end
    return found or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(6, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass
class Model:
    """Dictionaries and weights; without both classes in the sample every score is ``prior``."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        one, other = _compressor(self.toxic), _compressor(self.ordinary)
        out = np.zeros((len(texts), 7))
        for i, text in enumerate(texts):
            parts = windows(text)
            gain = np.array([len(other.compress(w)) - len(one.compress(w)) for w in parts], dtype=float)
            up = np.sort(np.maximum(gain, 0))[::-1]
            top = max(1, len(up) // 4)
            out[i] = (1, gain.mean(), log(up.mean() + 0.02), (gain >= 2).mean(), log(up[:top].mean() + 0.05), min(up[0], 12), (gain >= 3).mean())
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Newton's method with a small ridge on standardised columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    mean[0], sd[0] = 0, 1
    sd[sd == 0] = 1
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) / len(y) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = w / sd
    raw[0] -= (w[1:] * mean[1:] / sd[1:]).sum()
    return raw


def _contexts(texts: list[str]) -> tuple[dict[str, int], int]:
    """In how many different contexts each word stands; their sum."""
    seen = defaultdict(set)
    for text in texts:
        words = [w.strip(_EDGES) for w in text.lower().split()]
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            seen[word].add((before, after))
    return {w: len(c) for w, c in seen.items()}, sum(map(len, seen.values()))


def _marks(one: list[str], other: list[str]) -> bytes:
    """What recurs in one class and hardly in the other, the most frequent last (nearest to the window)."""
    (here, a), (there, b) = _contexts(one), _contexts(other)
    found = [w for w, n in here.items() if len(w) > 2 and n >= CONTEXTS and n * b >= RATIO * a * (there.get(w, 0) + 0.5)]
    return (" " + " ".join(sorted(found, key=lambda w: (here[w], w))) + " ").encode() if found else b""


def fit(rows: list[tuple[str | None, int, bool]], prior: float | None = None) -> Model:
    """rows: (text, label, whether it is for the dictionaries rather than for calibration).

    prior is the share of label 1 where the rows were sampled by class.
    """
    share = float(np.mean([y for _, y, _ in rows])) if rows else 0.0
    prior = share if prior is None else prior
    learn = [(t or "", y) for t, y, d in rows if d]
    tune = [(t, y) for t, y, d in rows if not d]
    one, other = [t for t, y in learn if y], [t for t, y in learn if not y]
    if not one or not other or len({y for _, y in tune}) < 2:
        return Model(b"", b"", None, prior)
    try:
        base = zstandard.train_dictionary(BASE_BYTES, [w for t in other for w in windows(t)]).as_bytes()[2048:]
    except zstandard.ZstdError:  # too few samples to train on
        base = " ".join(other).lower().encode()[:BASE_BYTES]
    model = Model(_marks(one, other) + base, base, None, prior)
    model.weights = _logistic(model.features([t for t, _ in tune]), np.array([y for _, y in tune], dtype=float))
    model.weights[0] += log(prior / (1 - prior)) - log(share / (1 - share))
    return model


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> tuple[list[tuple[str | None, int, bool]], float]:
    """At most ``rows`` labelled texts of each class that are not held out, and TRAIN_BYTES of them, by a hash of the id; the share of label 1 among all of these."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.where("_id is not null").withColumn("_h", F.xxhash64("_id"))
    prior = known.agg(F.avg("_y")).first()[0] or 0.0
    picked = known.where("_y = 1").orderBy("_h", "_id").limit(rows).union(known.where("_y = 0").orderBy("_h", "_id").limit(rows))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")  # 2 * rows ids
    # one text for each id, the first of those with the fewest bytes; no text that alone goes beyond the bound
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    found = found.where(size <= TRAIN_BYTES).groupBy("_id", "_y", "_h").agg(F.min(F.struct(size.alias("n"), F.col("_text").alias("text"))).alias("t"))
    sizes = found.select("_y", "_h", "t.n").collect()  # 2 * rows numbers
    within = F.lit(False)
    for y in (0, 1):
        own = sorted((r[1], r[2]) for r in sizes if r[0] == y)
        fits = int(np.searchsorted(np.cumsum([n for _, n in own]), TRAIN_BYTES, side="right"))
        if fits:
            within = within | ((F.col("_y") == y) & (F.col("_h") <= own[fits - 1][0]))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(3))
    return [(r[0], int(r[1]), r[2] != 0) for r in found.where(within).select("t.text", "_y", fold).collect()], prior


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, at: float = PREDICT_AT) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    A null text scores as an empty one; very long texts are scored over all their windows.  Repeated
    rows score alike; of rows that share a labelled id one text is learnt from.  Without
    labels of both classes the score is the share of toxic labels, 0 without any.  An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    model = fit(*sample(docs, labels, label_col, id_col, text_col, rows))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def score(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sent.value.scores(part.column(1).to_pylist()))], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    scored = base.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= at).cast("int").alias("predicted"))
