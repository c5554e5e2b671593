"""Operators whose results a few plain lines give as well."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from samewise.llm import fingerprints as fp
from samewise.llm import line_dedup, sharding

from .helpers import AWKWARD, docs, documents


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, 500)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k) % (1 << 64), n) for k in keys]


def test_shards(spark, data):
    rows = documents(spark, data) + [(i, t) for i, t in AWKWARD]
    found = sharding.shard(docs(spark, rows), 24).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        assert r.law == "key" and r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    assert len({r.shard for r in found if r.doc_id == 5}) == 1
    assert sharding.shard(docs(spark, []), 24).count() == 0


_SPACE = " \t\n\x0b\x0c\r"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows):
    key = lambda line: line.strip(_SPACE).translate(_LOW)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    drop = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, data):
    many = [(100 + i, f"a line that everyone shares\n own line number {i} \nA LINE that everyone shares\x0b\nÉté et ÉTÉ, une longue ligne {i % 3}") for i in range(300)]
    rows = documents(spark, data) + many + [r for r in AWKWARD if r[0] is not None]
    found = line_dedup.dedup_report(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == plain_lines(rows)


def test_line_dedup_texts_and_edges(spark):
    rows = [(i, "this line is long enough to count\nshort\nrow %d" % i) for i in range(5)] + [(None, "this line is long enough to count"), (9, None)]
    out = line_dedup.without_repeated_lines(docs(spark, rows))
    got = {r.doc_id: (r.text, r.n_chars, r.tag) for r in out.collect()}
    assert out.columns == docs(spark, []).columns
    assert got[4][0].startswith("this line") and got[0] == ("short\nrow 0", 11, 7) and got[None][0] == "" and got[9][0] is None
    assert line_dedup.dedup_report(docs(spark, [])).count() == 0


def test_a_line_in_every_document_is_split(spark):
    rows = [(i, "the very same line in every document") for i in range(3000)]
    found = line_dedup.dedup_report(docs(spark, rows)).where("n_dropped = 0").collect()
    assert [r.doc_id for r in found] == [2999]


def test_fingerprints(spark, data):
    rows = documents(spark, data) + [r for r in AWKWARD if r[0] not in (5, None)][:3]
    rows = [(1000 * k + (i or 0), t) for k, (i, t) in enumerate(rows)]
    found = {r.doc_id: r for r in fp.fingerprints(docs(spark, rows)).collect()}
    ordered = sorted(rows)
    assert len(found) == len(rows)
    same = defaultdict(set)
    for (i, t), (j, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u = t or "", u or ""
        q = len(t) // 4
        new = t[: len(t) - q] + u[:q]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        own, changed = fp.sketches([t.encode(), new.encode()])
        assert r.fingerprint == own.astype(">u2").tobytes().hex() and r.near_edited == (own == changed).mean()
        assert 0 <= r.near_next <= 1
        same[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    long = [r for r in found.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert fp.fingerprints(docs(spark, [])).count() == 0
    lone = fp.fingerprints(docs(spark, [(1, "alone and unchanged")])).collect()
    assert lone[0].near_next == 1.0


def test_fingerprints_follow_edits():
    rnd = np.random.default_rng(2)
    text = "".join(rnd.choice(list("abcdefgh "), 3000))
    likes = []
    for edits in (0, 20, 100, 1000):
        chars = list(text)
        for i in rnd.choice(3000, edits, replace=False):
            chars[i] = "z"
        a, b = fp.sketches([text.encode(), "".join(chars).encode()])
        likes.append((a == b).mean())
    assert likes[0] == 1 and likes == sorted(likes, reverse=True) and likes[-1] < 0.1
    halves = text[1500:] + text[:1500]
    a, b = fp.sketches([text.encode(), halves.encode()])
    assert (a == b).mean() < 0.75  # moved blocks cost, though the content is the same


def plain_sketch(text):
    """The two smallest of all k-mers in every order, one by one."""
    top, raw, seen, e = (1 << 64) - 1, text.encode(), Counter(), []
    starts = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80]
    starts = [i for i in starts if i + fp.K <= len(raw)] or starts[:1]
    for i in starts if len(raw) >= fp.K else [0]:
        part = raw[i : i + fp.K]
        h = int(fp.vec.mix(np.array([sum((c + 1) * pow(fp.vec.BASE, j, 1 << 64) for j, c in enumerate(part)) & top], dtype=np.uint64))[0])
        e.append(h + seen[h] * 0xC2B2AE3D27D4EB4F & top)
        seen[h] += 1
    e = [int(x) for x in fp.vec.mix(np.array(e, dtype=np.uint64))]
    out = []
    for p, odd in enumerate(fp._ODD.tolist()):
        chosen = sorted(sorted(range(len(e)), key=lambda i: ((e[i] * odd & top) >> 32, i))[:2])
        a, b = e[chosen[0]], e[chosen[1]] if len(chosen) > 1 else 0
        out.append(int(fp.vec.mix(np.array([a * fp.vec.STEP + b + p & top], dtype=np.uint64))[0]) >> 48)
    return out


def test_fingerprints_are_of_all_kmers():
    texts = ["one", "a few words", "again and again and again and again", "日本語のテキスト 😀 été", "".join(np.random.default_rng(4).choice(list("abcdefgh "), 700))]
    assert fp.sketches([t.encode() for t in texts]).tolist() == [plain_sketch(t) for t in texts]


def test_fingerprints_of_short_texts_are_graded():
    rnd = np.random.default_rng(5)
    texts = ["".join(rnd.choice(list("abcdefghijklmnop"), 24)) for _ in range(300)]
    a, b = fp.sketches([t.encode() for t in texts]), fp.sketches([(t[:-1] + "z").encode() for t in texts])
    likes = (a == b).mean(axis=1)  # 16 of 17 k-mers are common, so a pair of common ones is expected in 16 * 15 of 18 * 17 cases
    assert abs(likes.mean() - 0.784) < 0.04 and likes.min() > 0.4 and likes.max() < 1


def test_fingerprints_do_not_depend_on_their_slice():
    rnd = np.random.default_rng(8)
    texts = ["".join(rnd.choice(list("abcdefgh "), n)).encode() for n in (3, 40, 900)]
    beside = ["".join(rnd.choice(list("xyz "), n)).encode() for n in (100_000, 5, 30_000)]
    alone = [fp.sketches([t])[0].tolist() for t in texts]
    assert alone == fp.sketches([*beside, *texts])[3:].tolist() == fp.sketches([texts[0], beside[0], *texts[1:]])[[0, 2, 3]].tolist()


def test_fingerprints_of_an_id_of_many_rows(spark):
    rows = [(i, f"text number {i}") for i in range(40)] + [(20, f"one of many rows, {i}") for i in range(80)] + [(None, f"no id {i}") for i in range(60)]
    found = fp.fingerprints(docs(spark, rows)).collect()
    placed = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(text) as o").collect()
    ordered = [r.text for r in sorted(placed, key=lambda r: (r.id is not None, r.id or 0, r.o))]
    expected = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for t, u in zip(ordered, ordered[1:] + ordered[:1]))
    assert Counter(r.edited_sha256 for r in found) == expected
    with pytest.raises(TypeError):
        fp.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
