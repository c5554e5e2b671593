from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from samewise.llm import near_dedup, vec

from .helpers import AWKWARD, docs, documents, shingles


def brute(rows, k, num, den):
    """Component of every distinct row by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
    return {i: (len(s), root(i)) for i, s in sets}


def check(spark, rows, k, num, den):
    found = near_dedup.near_duplicates(docs(spark, rows), k=k, num=num, den=den).collect()
    expected = brute(rows, k, num, den)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_equals_all_pairs_on_documents(spark, data):
    check(spark, documents(spark, data), 3, 85, 100)


def test_chains_of_near_copies(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text, rows = [rnd.choice(words) for _ in range(150)], []
    for i in range(120):  # every copy drifts from the one before
        rows.append((i, " ".join(text)))
        text = text[:]
        text[rnd.randrange(150)] = rnd.choice(words)
    rows += [(1000 + i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(40)]
    check(spark, rows, 3, 85, 100)
    check(spark, rows, 5, 80, 100)


def test_awkward_rows(spark):
    found = near_dedup.near_duplicates(docs(spark, AWKWARD), k=3, num=85, den=100).collect()
    assert len(found) == len(AWKWARD)
    by = {r.doc_id: r for r in found}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[4].n_shingles == by[7].n_shingles == by[8].n_shingles == 1
    assert by[6].component_id == 5 and not by[6].kept
    assert by[None].component_id is None


def test_empty_table_and_keep_one(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = near_dedup.keep_one(docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and "tag" in kept.columns


def test_signatures_estimate_likeness():
    rnd = np.random.default_rng(1)
    m = 192
    for share in (0.3, 0.6, 0.85):
        both = rnd.integers(0, 1 << 62, int(400 * share), dtype=np.uint64)
        own = [rnd.integers(0, 1 << 62, (400 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, o])) for o in own]
        sig = near_dedup.superminhash(np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets), 2, m)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    small = near_dedup.superminhash(np.zeros(2, np.int64), np.array([1, 2], np.uint64), 1, m)
    assert (small < np.iinfo(np.uint64).max).all()  # every slot is filled however small the set


def test_bands_miss_bound():
    for t in (0.8, 0.85, 0.95):
        b, r = near_dedup.bands_for(t)
        assert (1 - t**r) ** b <= near_dedup.MISS and b * r <= 256


def test_words_do_not_depend_on_slices():
    texts = [t or "" for _, t in AWKWARD] * 3
    whole = [s.words.tolist() for s in vec.slices(pa.array(texts), 1 << 30)]
    parts = [w for s in vec.slices(pa.array(texts), 64) for w in s.words.tolist()]
    assert sum(whole, []) == parts
    long = "ab cd " * 300_000
    a = next(vec.slices(pa.array([long]))).words
    assert len(a) == 600_000 and len(np.unique(a)) == 2


def test_names_and_types_of_columns(spark):
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None)]
    clashing = docs(spark, rows).withColumnsRenamed({"lang": "kept_id", "source": "group"})
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_strays_do_not_multiply_the_copies(spark):
    members = [(7, i, 4000, 0) for i in range(1000)] + [(7, 5000, 4000, 5000)]  # eight blocks of one component, and one stray
    placed = spark.createDataFrame(members, "bucket long, rep long, n long, comp long")
    dealt = near_dedup._dealt(placed).collect()
    copies = sum(r.rep < 1000 for r in dealt)
    blocks = {r.block for r in dealt if r.rep < 1000}
    assert copies == 1000 and len(blocks) == 8 and all(r.block < 0 for r in dealt if r.rep < 1000)
    assert {(r.bi, r.bj) for r in dealt if r.rep == 5000} == {(b, 0) for b in blocks} | {(0, 0)}
    assert near_dedup._dealt(placed.where("comp = 0")).count() == 0
