"""Every query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from samewise import queries
from samewise.operators import alike, candidates, cluster, compare, decisions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def shown(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", ["catalogue_groups", "cannot_link_groups"])
def test_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered_queries_normalise_unicode(spark, tmp_path, monkeypatch):
    rows = [(1, "1", "ｒｅｄ ｂｏｌｔ Ｍ５", "ＡＢＢ", 4.0, 2.0)]
    frame = spark.createDataFrame(rows, "row long, code string, name string, brand string, stock double, unit_cost double")
    monkeypatch.setattr(queries.catalogue, "derived", lambda *_: frame)
    norm = queries._items_plan(spark, "").first().norm
    assert (norm.text, norm.brand, norm.types, norm.colours) == ("red bolt m5", "abb", ["bolt"], ["red"])
    spark.createDataFrame([(1, "ｒｅｄ ｂｏｌｔ")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["dictionary_types"](spark, str(tmp_path)).first()
    assert (found.types, found.colours) == ("bolt", "red")


UNFOLDED = "conflict_codes name_similarity one_per_cluster_pair override_join unsure_topk verdict_ladder cache_probe lookalike_pairs pairs_tagged wrong_and_missed".split()


@pytest.mark.parametrize("name", UNFOLDED)
def test_pairs_unfold_after_judging(spark, data, name):
    """Pairs come from chunks of rows with one text, which are judged before they unfold."""
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(ys" in plan


@pytest.mark.parametrize("name", ["lookalike_pairs", "conflict_codes"])
def test_nouns_of_names_with_any_number_of_words(spark, tmp_path, name):
    """Noun, type and size are those of part, however many words stand before and after the size."""
    names, types = ["ring", "old ring", "old ring wide", "wide old big ring"], ["LARGE", "LARGE OVAL", "LARGE ROUND", "Large"]
    rows = [(i, names[i % 4], f"Brand#{i // 32 % 2}", types[i // 4 % 4], (1, 2, 4, 21, 17)[i % 5], 900.0) for i in range(160)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 2.0)], "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    expected = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(map(shown, r)) for r in expected) != []


def test_groups_of_chunks_are_those_of_pairs():
    rng = random.Random(5)
    grouped = 0
    for _ in range(300):
        numbers = rng.sample(range(60), rng.randint(2, 24))
        mark = (lambda r: r % 10) if rng.random() < 0.7 else (lambda r: r)
        told = [(x, -x % 10) for x in range(10)] if rng.random() < 0.8 else []
        count = rng.randint(1, 5)
        chunks = [c for c in (sorted(numbers[i::count]) for i in range(count)) if c]
        signs = {c[0]: rng.randint(0, 2) for c in chunks}
        clash = [(s, t) for s in range(3) for t in range(s + 1, 3) if rng.random() < 0.3]
        whole = [("chunk", c[0], signs[c[0]], c, [mark(r) for r in c], None, None, None) for c in chunks]
        plain = [("row", r, None, signs[c[0]], None, None, None, None) for c in chunks for r in c]
        whole += [("apart", x, y, None, None, None, None, None) for x, y in told]
        whole += [("clash", s, t, None, None, None, None, None) for s, t in clash]
        plain += [("clash", None, None, s, t, None, None, None) for s, t in clash]
        for x in chunks:
            for y in chunks:
                linked = rng.random() < 0.7
                level, score, detail = rng.randint(1, 3), rng.choice([0.5, 0.7, 1.0]), rng.choice("pqrstu")
                if linked:
                    whole.append(("edge", x[0], y[0], None, None, level, score, detail))
                for a in x:
                    for b in y:
                        if a < b and (mark(a), mark(b)) in told:
                            plain.append(("apart", a, b, None, None, None, None, None))
                        elif a < b and linked:
                            plain.append(("edge", a, b, None, None, level, score, detail))
        rng.shuffle(whole)
        found = sorted(cluster._merge_chunks(whole))
        assert found == sorted(cluster._merge(plain))
        grouped += len(found)
    assert grouped > 1000


def test_cannot_link_groups_makes_no_pairs(spark, data, tmp_path, monkeypatch):
    """The rows are those of the pairs, decided one by one, on rows with copies."""
    for table, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        times = spark.range(8).withColumnRenamed("id", "i")
        spark.read.parquet(f"{data}/{table}.parquet").crossJoin(times).withColumn(key, F.col(key) + F.col("i") * 201).drop("i").write.parquet(f"{tmp_path}/{table}.parquet")
    items = queries._items_plan(spark, str(tmp_path)).localCheckpoint()
    keyed = items.select("row", F.concat_ws("|", "norm.brand", "norm.dims.thread").alias("key"), F.col("norm.brand").alias("brand"))
    pairs = compare.compare(candidates.block_pairs(keyed, cap=1 << 30), items)
    told = pairs.where((F.col("a") + F.col("b")) % 10 == 0).select("a", "b", F.lit("different").alias("verdict"))
    expected = cluster.members_of(decisions.with_decisions(pairs, told), items).select("row", "cluster", "confidence", F.array_join("reasons", " ").alias("reasons")).collect()

    def pairs_made(*_, **__):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(candidates, "block_pairs", pairs_made)
    monkeypatch.setattr(alike, "unfolded", pairs_made)
    assert sorted(entry.queries()["cannot_link_groups"](spark, str(tmp_path)).collect()) == sorted(expected) != []


@pytest.mark.parametrize(("block_rows", "total"), [(2_000, 20_000), (100_000, 20_000), (7, DataFrame)])
def test_rare_token_neighbours_counts_in_cells(spark, monkeypatch, block_rows, total):
    """The rows are those of a plain count, on one block or many, and no join meets pairs."""
    monkeypatch.setattr(candidates, "BLOCK_ROWS", block_rows)
    rng = random.Random(3)
    words = {r * 1000 + 7: {f"w{min(int(rng.expovariate(0.1)), 40)}" for _ in range(rng.randint(0, 9))} | ({"all"} if r % 2 else set()) for r in range(90)}
    limit, n = (200, total) if total == 20_000 else (25, spark.range(90).agg(F.count("*").alias("total")))
    stands = Counter(w for held in words.values() for w in held)
    rare = {r: {w for w in held if 1 < stands[w] <= limit} for r, held in words.items()}
    expected = []
    for a, held in rare.items():
        shared = sorted((-len(held & other), b) for b, other in rare.items() if a != b and held & other)
        expected += [(a, b, -less) for less, b in shared[:12]]
    found = candidates.rare_token_neighbours(spark.createDataFrame([(r, w) for r, held in words.items() for w in sorted(held)], "row long, token string"), n)
    assert sorted(map(tuple, found.collect())) == sorted(expected) != []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner, (token" not in plan
