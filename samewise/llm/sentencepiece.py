"""SentencePiece encoding and decoding on a lattice of pieces.

A text is cut into words (runs of the space mark and what follows them; no
piece of the vocabularies reaches over such a cut).  For the words of a batch
that are not known yet, all substrings up to the longest piece are exploded and
equi-joined, by hash, with the piece table; the edges are grouped by word and
folded.  A unigram vocabulary folds by Viterbi (the largest sum of scores).  A
BPE vocabulary orders merges by score and the largest sum does not give its
encoding, so its fold repeatedly joins the two neighbouring spans whose common
edge has the best score, the leftmost of equals.  Words of a batch are folded
side by side, by length.

The piece table is read on the driver from a model file, whose path is a
parameter, and sent to the executors: its size is that of the vocabulary.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KNOWN_WORDS = 60_000
LONG = 48
#: Text encoded at a time: new words are learnt together.
BATCH_BYTES = 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)


@dataclass
class Pieces:
    """A vocabulary: pieces that text can match, their scores, byte pieces, and what each id decodes to."""

    ids: dict[str, int]
    score: dict[str, float]
    bytes_: list[int]
    unknown: int
    decoded: list[bytes]
    merges: bool = True
    prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL, merges: bool = True) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids, score, bytes_, decoded = {}, {}, [-1] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                decoded.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                ids[piece], score[piece] = i, sp.get_score(i)
                decoded.append(piece.replace(MARK, " ").encode())
        return cls(ids, score, bytes_, sp.unk_id(), decoded, merges)


@dataclass
class Encoder:
    """Encodes words through their lattices.

    Words seen in two batches are kept, up to KNOWN_WORDS; words seen in one wait
    in a second, equally bounded table for their next time.
    """

    pieces: Pieces
    known: dict[str, bytes] = field(default_factory=dict)
    once: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        p = self.pieces
        self.longest = max((len(x) for x in p.ids), default=1)
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in p.ids):
            raise ValueError("pieces that reach over a space mark are not supported")
        alone = "".join(c for c in "\n\r\t" if not any(c in x for x in p.ids))
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        names = list(p.ids)
        points = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(x) for x in names])
        total = self._totals(points)
        begins = ends - np.array([len(x) for x in names])
        inverse = vec.powers(vec.BASE_INV, len(points) + 1)
        keys = vec.mix((total[ends] - total[begins]) * inverse[begins])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ids = np.array([p.ids[x] for x in names], dtype=np.int32)[order]
        scores = np.array([p.score[x] for x in names])[order]
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.scores = scores
        bits = 20
        self.shift = np.uint64(64 - bits)
        slot = self.keys >> self.shift
        self.slots = np.full(1 << bits, -1, dtype=np.int32)  # place of the key with these first bits, -2 for several
        self.slots[slot] = np.arange(len(self.keys))
        again = slot[1:][slot[1:] == slot[:-1]]
        self.slots[again] = -2

    @staticmethod
    def _totals(points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * vec.powers(vec.BASE, len(points) + 1)[: len(points)], out=total[1:])
        return total

    def lattice(self, words: list[str]) -> np.ndarray:
        """Edges of words of one length n: [word, begin, length] -> place in the sorted piece table, -1 without a piece."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        total, inverse = self._totals(points), vec.powers(vec.BASE_INV, len(points) + 1)
        top = min(n, self.longest)
        edges = np.full((len(words), n, top + 1), -1, dtype=np.int32)
        first = np.arange(len(words))[:, None] * n
        for length in range(1, top + 1):
            begin = (first + np.arange(n - length + 1)).reshape(-1)
            h = vec.mix((total[begin + length] - total[begin]) * inverse[begin])
            at = self.slots[h >> self.shift]
            some = np.flatnonzero(at != -1)
            at = at[some]
            several = np.flatnonzero(at == -2)
            at[several] = np.minimum(np.searchsorted(self.keys, h[some[several]]), len(self.keys) - 1)
            hit = self.keys[at] == h[some]
            begin, at = begin[some[hit]], at[hit]
            edges[begin // n, begin % n, length] = at
        return edges

    def _merged(self, edges: np.ndarray) -> np.ndarray:
        """Length of the span that begins at each place (0 inside a span), by merges."""
        words, n, top = edges.shape
        ranks = np.where(edges >= 0, self.ranks[edges], _NONE)
        spans = np.ones((words, n), dtype=np.int64)
        live = np.arange(words)
        place = np.arange(n)
        while len(live):
            own = spans[live]
            following = np.minimum(place + own, n - 1)
            both = own + np.take_along_axis(own, following, axis=1)
            ok = (own > 0) & (place + own < n) & (both < top)
            rank = np.where(ok, ranks[live[:, None], place, np.where(ok, both, 0)], _NONE)
            best = rank.argmin(axis=1)
            every = np.arange(len(live))
            some = rank[every, best] < _NONE
            live, best, every = live[some], best[some], every[some]
            spans[live, best + own[every, best]] = 0
            spans[live, best] = both[every, best]
        return spans

    def _viterbi(self, edges: np.ndarray) -> np.ndarray:
        """As _merged, by the largest sum of scores; a lone place without a piece costs more than any piece."""
        words, n, top = edges.shape
        worst = self.scores.min() - 10
        score = np.where(edges >= 0, self.scores[edges], -np.inf)
        score[:, :, 1] = np.where(edges[:, :, 1] >= 0, score[:, :, 1], worst)
        best, back = np.full((words, n + 1), -np.inf), np.zeros((words, n + 1), dtype=np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for length in range(1, min(end, top - 1) + 1):
                sum_ = best[:, end - length] + score[:, end - length, length]
                better = sum_ > best[:, end]
                best[better, end], back[better, end] = sum_[better], length
        spans, at = np.zeros((words, n), dtype=np.int64), np.full(words, n)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            length = back[live, at[live]]
            at[live] -= length
            spans[live, at[live]] = length
        return spans

    def _bytes(self, char: str) -> list[int]:
        found = [self.pieces.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.pieces.unknown] if -1 in found else found

    def _long(self, word: str) -> bytes:
        """Merges of one very long word, by a queue."""
        ids, score, n = self.pieces.ids, self.pieces.score, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and end[j] - i <= self.longest and (s := score.get(word[i : end[j]])) is not None:
                heapq.heappush(queue, (-s, i, j, end[j]))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if gone[i] or gone[j] or end[i] != j or end[j] != k:
                continue
            gone[j], end[i] = True, k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        found: list[int] = []
        i = 0
        while i < n:
            span = word[i : end[i]]
            found += [ids[span]] if span in ids else self._bytes(span)
            i = end[i]
        return np.array(found, dtype="<i4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, as bytes of int32."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG and self.pieces.merges:
                out[w] = self._long(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, every in by_length.items():
            step = max(1, 400_000 // (n * (min(n, self.longest) + 1)))
            for at in range(0, len(every), step):
                part = every[at : at + step]
                edges = self.lattice(part)
                spans = self._merged(edges) if self.pieces.merges else self._viterbi(edges)
                row, begin = np.nonzero(spans)
                place = edges[row, begin, spans[row, begin]]
                ids = np.where(place >= 0, self.key_ids[place], -1).astype("<i4")
                bounds = np.searchsorted(row, np.arange(len(part) + 1)) * 4
                whole = ids.tobytes()
                out.update(zip(part, (whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())), strict=True))
                for r in np.unique(row[ids < 0]).tolist():  # characters without a piece fall back to bytes
                    own = row == r
                    found: list[int] = []
                    for i, b in zip(ids[own].tolist(), begin[own].tolist(), strict=True):
                        found += [i] if i >= 0 else self._bytes(part[r][b])
                    out[part[r]] = np.array(found, dtype="<i4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as bytes of int32; none for null or empty texts."""
        cut = []
        for t in texts:
            t = (t or "").replace(" ", MARK)
            cut.append(self.words.findall(MARK + t if self.pieces.prefix else t) if t else [])
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > 2 * KNOWN_WORDS:
            self.known.clear()
            missing = set().union(*cut)
        again = missing.intersection(self.once)
        known = self.known
        known.update((w, self.once.pop(w)) for w in again)
        learnt = self.learn(missing.difference(again))
        known.update(learnt)
        out = [b"".join([known[w] for w in words]) for words in cut]
        for w in learnt:
            del known[w]
        if len(self.once) + len(learnt) > KNOWN_WORDS:
            self.once.clear()
        self.once.update(learnt)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.pieces.decoded
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text[:1] == " " else text


def _ids(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, exact) for every row; exact tells whether decoding gives the text back.

    Null and empty texts have no ids.  Texts with the space mark itself decode
    to a space there and are not exact.  Very long texts are encoded whole.  Repeated rows give
    repeated results; an empty table gives no rows; other columns, whatever their names,
    are not read.  Rows are not shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces or Pieces.load())

    def run(batches):
        encoder = Encoder(sent.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                end, held = at + 1, int(sizes[at])
                while end < batch.num_rows and held + sizes[end] <= BATCH_BYTES:
                    held += int(sizes[end])
                    end += 1
                part = texts.slice(at, end - at).to_pylist()
                found = encoder.encode(part)
                exact = [encoder.decode(np.frombuffer(x, dtype="<i4").tolist()) == (t or "") for x, t in zip(found, part, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(x) // 4 for x in found], pa.int64()), _ids(found), pa.array(exact)], names=["id", "n_tokens", "ids", "exact"])
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(vec.tidy(run), f"id {kind}, n_tokens long, ids array<int>, exact boolean").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null or no ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(pieces or Pieces.load())

    def run(batches):
        encoder = Encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
