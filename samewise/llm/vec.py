"""Vectorised tokens and shingles over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  White space and
A-Z are single bytes in UTF-8, so everything here works on raw bytes without
decoding.  A word's hash is a polynomial over its bytes modulo 2**64 followed
by a bit mix; a shingle's hash is a polynomial over its words' hashes.

Work is done on slices of about a quarter of a megabyte, so the memory needed beside an
Arrow batch is a small multiple of the slice or of the longest text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For texts in which punctuation is noise: every ASCII byte but letters and digits parts words.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[128:] = False
for _first, _last in ("09", "AZ", "az"):
    PUNCTUATION[ord(_first) : ord(_last) + 1] = False
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def tidy(function):
    """For a function over Arrow batches: a worker that waits for its next task gives freed memory back."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return run


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        factors = np.full(size, base, dtype=U64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size > 4 * SLICE_BYTES:
            return have[:n]
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> pa.Array:
    """Hashes as a column of long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Slice:
    """Tokens of consecutive rows first..last-1 of a batch."""

    first: int
    last: int
    words: np.ndarray  # uint64 hashes of the words
    doc: np.ndarray  # row of each word, from 0 at ``first``
    begin: np.ndarray  # byte range of each word within the slice
    end: np.ndarray
    base: int  # byte at which the slice starts within the batch

    def bounds(self) -> np.ndarray:
        """Index of each row's first word; one more at the end."""
        return np.searchsorted(self.doc, np.arange(self.last - self.first + 1))


def _tokens(raw: np.ndarray, cuts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of the words in raw; a word ends at a cut too."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[raw]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_LOWER[raw] * powers(BASE, n), out=total[1:])
    words = mix((total[end] - total[begin]) * powers(BASE_INV, n)[begin])
    return words, begin, end


def _long(raw: np.ndarray, space: np.ndarray, part: int = 4 * SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _tokens for one very long text, in parts cut at white space."""
    found, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + part)
        while stop < len(raw):
            gaps = np.flatnonzero(space[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(len(raw), stop + part)
        words, begin, end = _tokens(raw[at:stop], np.zeros(1, np.int64), space)
        found.append((words, begin + at, end + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _tokens(raw, np.zeros(1, np.int64))


def slices(column: pa.Array, limit: int = SLICE_BYTES, space: np.ndarray = _SPACE) -> Iterator[Slice]:
    """The tokens of a text column, slice by slice."""
    raw, offsets = buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, rows)
        part = raw[offsets[first] : offsets[last]]
        starts = offsets[first:last] - offsets[first]
        words, begin, end = _tokens(part, starts, space) if len(part) <= 4 * SLICE_BYTES else _long(part, space)
        doc = np.searchsorted(starts, begin, side="right") - 1
        yield Slice(first, last, words, doc, begin, end, int(offsets[first]))
        first = last


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; run i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= U64(STEP)
        h += words[i : n + i]
    return mix(h)


def shingles(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words within one row, in text order.

    A row with one to k-1 words has its whole sequence as its one shingle.
    """
    h = grams(s.words, k)
    same = s.doc[: len(h)] == s.doc[k - 1 : k - 1 + len(h)]
    doc, h = s.doc[: len(h)][same], h[same]
    bounds = s.bounds()
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        more = np.array([grams(s.words[bounds[d] : bounds[d + 1]], int(sizes[d]))[0] ^ U64(0xA5A5 + int(sizes[d])) for d in short], dtype=U64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, more])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted within each row, and each row's bounds."""
    ends = np.searchsorted(doc, np.arange(rows + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    return np.repeat(np.arange(rows), sizes), flat, bounds


class Index:
    """Where each of a bounded set of hashes occurs: a bitmap to skip the rest, then a sorted list."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]
        bits = max(12, int(16 * max(1, len(keys))).bit_length())
        self.shift = U64(64 - bits)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[self.keys >> self.shift] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(positions in h, values at them), one row for each occurrence of the key."""
        at = np.flatnonzero(self.bitmap[h >> self.shift])
        low = np.searchsorted(self.keys, h[at], side="left")
        n = np.searchsorted(self.keys, h[at], side="right") - low
        some = n > 0
        at, low, n = at[some], low[some], n[some]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), [v[np.repeat(low, n) + inner] for v in self.values]
