from __future__ import annotations

import random

import numpy as np
import sentencepiece as library
from pyspark.sql import functions as F

from samewise.llm import decontaminate as dc
from samewise.llm import licenses
from samewise.llm import sentencepiece as sp

from .helpers import AWKWARD, docs, documents, words


def plain_tiles(item, text, k):
    """Greedy string tiling, step by step."""
    a, b = [False] * len(item), [False] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for j in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        total += n
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n


BENCH = "item_id long, text string"


def test_tiling_equals_plain_tiling(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("abcdefghij") * 2 for _ in range(rnd.randint(5, 25)))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, "")]
    rows = []
    for d in range(40):
        parts = [rnd.choice(items[:12])[1].split() for _ in range(2)]
        cut = rnd.randrange(1, len(parts[0]))
        rows.append((d, " ".join(parts[0][cut:] + ["zz"] * rnd.randrange(3) + parts[0][:cut] + parts[1][: rnd.randrange(9)])))
    rows += [(90, "so Tiny  item it is"), (91, None), (92, "")]
    expected = set()
    for d, t in rows:
        for i, b in items:
            w = words(b)
            if w:
                n = plain_tiles(w, words(t), min(5, len(w)))
                if n >= 0.6 * len(w):
                    expected.add((d, i, n, len(w)))
    bench = spark.createDataFrame(items, BENCH)
    found = dc.contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.words_marked, r.words) for r in found} == expected
    kept = dc.without_leaks(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, *_ in expected}
    assert kept.columns == docs(spark, []).columns
    clashing = docs(spark, rows).withColumnsRenamed({"lang": "g1", "source": "f", "tag": "i2"})
    assert dc.without_leaks(clashing, bench).count() == kept.count()
    named = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(named, bench.withColumn("item_id", F.col("item_id").cast("string"))).collect()} == {(f"d{d}", str(i)) for d, i, *_ in expected}


def test_decontamination_edges(spark, data):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], BENCH)
    assert sorted(r.doc_id for r in dc.contaminated(docs(spark, AWKWARD), bench).collect()) == [5, 5, 6]
    assert dc.contaminated(docs(spark, AWKWARD), spark.createDataFrame([], BENCH)).count() == 0
    assert dc.contaminated(docs(spark, []), bench).count() == 0
    real = spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(spark, documents(spark, data)), real).collect()}
    whole = {(i, b.item_id) for i, t in documents(spark, data) for b in real.collect() if " ".join(words(b.text)) in " ".join(words(t))}
    assert whole <= found


def test_licenses(spark, data):
    mit = licenses.TEMPLATES["MIT"].split()
    changed = mit[:30] + ["inserted"] + mit[30:60] + mit[62:]
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{filler} {' '.join(changed)} {filler}"), (2, "... released under the mit   license!"), (3, filler), (4, "Licensed under the MIT Licence"), *AWKWARD[:3]]
    found = {(r.doc_id, r.license): r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert set(found) == {(1, "MIT"), (2, "MIT (notice)")}
    r = found[1, "MIT"]
    assert 0.8 <= r.containment < 1 and 290 <= r.first_word <= 310
    assert licenses.license_scan(docs(spark, [])).count() == 0
    marks = {"GPL-3.0 (notice)": "GNU General Public License, version 3", "MIT (notice)": "Released under the MIT License", "CC-BY-NC-4.0 (notice)": "CC BY-NC 4.0", "Apache-2.0 (notice)": "Apache License, Version 2.0"}
    got = {(x.doc_id, x.license) for x in licenses.license_scan(docs(spark, documents(spark, data))).collect()}
    assert got == {(i, name) for i, t in documents(spark, data) for name, m in marks.items() if m in t}


def test_sentencepiece_equals_library(spark, data):
    lib = library.SentencePieceProcessor(model_file=sp.MODEL)
    rnd = random.Random(1)
    odd = ["", " ", " a", "a  b   c    d     e", "\n\n\t x", "ﬁ Ⅷ 😀😀", "x" * 700, "ab" * 2000, "<s></s><unk><0x0A>", "a b", "\r\n \r", "".join(rnd.choice("abc \nथ") for _ in range(3000)), " " * 100]
    rows = documents(spark, data) + [(10_000 + i, t) for i, t in enumerate(odd)] + [(20_000, None)]
    found = {r.doc_id: r for r in sp.encode(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        assert list(found[i].ids or []) == (lib.encode(t) if t else []) and found[i].n_tokens == len(found[i].ids or [])
        assert found[i].exact
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs(spark, rows))).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert sp.encode(docs(spark, [])).count() == 0


def test_words_forgotten_and_seen_again(monkeypatch):
    monkeypatch.setattr(sp, "KNOWN_WORDS", 5)
    e = sp.Encoder(sp.Pieces.load())
    texts = ["alpha beta gamma", "beta gamma delta", "alpha beta", "epsilon zeta eta theta", "alpha"] * 3
    lib = library.SentencePieceProcessor(model_file=sp.MODEL)
    for t in texts:
        assert np.frombuffer(e.encode([t])[0], "<i4").tolist() == lib.encode(t)


def test_viterbi_is_the_best_sum():
    rnd = random.Random(7)
    names = {"▁", "a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cab"}
    pieces = sp.Pieces({p: i for i, p in enumerate(sorted(names))}, {p: -rnd.random() * len(p) for p in names}, [100 + b for b in range(256)], 99, [b""] * 400, merges=False)
    e = sp.Encoder(pieces)

    def best(word):
        if not word:
            return 0.0, []
        return max((pieces.score[word[:n]] + best(word[n:])[0], [pieces.ids[word[:n]], *best(word[n:])[1]]) for n in range(1, len(word) + 1) if word[:n] in names)

    for _ in range(60):
        word = "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
        ids = np.frombuffer(e.learn({word})[word], "<i4").tolist()
        back = {i: p for p, i in pieces.ids.items()}
        assert "".join(back[i] for i in ids) == word
        assert abs(sum(pieces.score[back[i]] for i in ids) - best(word)[0]) < 1e-9


def test_every_place_of_a_license(spark):
    mit, gpl, agpl = (licenses.TEMPLATES[k] for k in ("MIT", "GPL", "AGPL"))
    n = len(mit.replace("/", " ").split())
    filler = " ".join(f"filler{i}" for i in range(300))
    near = gpl.replace("Foundation", "Fund").replace("This program is", "It is")
    notice = "Released under the MIT License."
    rows = [(1, f"{mit} {filler} {mit}"), (2, f"{mit} {mit}"), (3, f"{agpl} {filler} {near}"), (4, f"{notice} {notice} {notice}"), (5, f"{gpl} {agpl}")]
    found = {}
    for r in licenses.license_scan(docs(spark, rows)).orderBy("doc_id", "first_word").collect():
        found.setdefault(r.doc_id, []).append((r.license, r.first_word, r.end_word))
    assert found[1] == [("MIT", 0, n), ("MIT", n + 300, 2 * n + 300)] and found[2] == [("MIT", 0, n), ("MIT", n, 2 * n)]
    assert [x[0] for x in found[3]] == ["AGPL", "GPL"] and [x[0] for x in found[5]] == ["GPL", "AGPL"]
    assert found[4] == [("MIT (notice)", 5 * i, 5 * i + 5) for i in range(3)]
