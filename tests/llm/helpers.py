"""Small awkward tables and plain re-implementations for comparison."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, tag int, score double"


def docs(spark, rows):
    """Documents from (doc_id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, 0.5) for i, t in rows], DOCS)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, "One TWO three four five six seven eight nine ten eleven twelve"),
    (7, "x" * 50_000),
    (8, "word " * 40_000),
    (9, "日本語のテキスト 😀 été\r\nline two of the text is here\n\nline two of the text is here"),
    (None, "a null id with a few words"),
]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def documents(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
