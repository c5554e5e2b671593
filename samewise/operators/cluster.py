"""Groups of rows from "same" pairs, under cannot-link constraints.

Merges never cross a connected component of the "same" pairs, so components are
found first (distributed), and each is then agglomerated on its own, strongest
pair first: two clusters join unless any of their rows are in hard conflict (a
person's "same" skips this test) or told apart by a decision.  A task holds the
rows and pairs of one component; where rows stand in chunks (``members_of_chunks``),
its rows and the pairs of its chunks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import alike
from .compare import READ, facts_of, held_rules
from .components import components

STRENGTH = {"reviewed": 3, "high": 2, "medium": 1}
#: What the hard rules read; rows that agree in all of these never conflict.
SIGNATURE = ("brand", "part_base", "variants", "variant_classes", "types", "colours", "materials", "codes", "numbers", "dims")
MEMBERS = "row long, cluster long, confidence string, reasons array<string>"


def strength(confidence: Column) -> Column:
    return F.coalesce(*(F.when(confidence == k, F.lit(v)) for k, v in STRENGTH.items()), F.lit(0))


def signature(norm: Column) -> Column:
    read = [norm[f] for f in SIGNATURE if f != "dims"] + [norm["dims"][f] for f in ("thread", "length_mm", "sizes_mm", "power_w", "voltage_v", "current_a", "poles")]
    return F.xxhash64(*read, norm["script"] == "arabic")


def signature_conflicts(placed: DataFrame) -> DataFrame:
    """(component, s, t) for the signatures of a component that are in hard conflict, s < t; from placed(component, sig, norm)."""
    one = placed.groupBy("component", "sig").agg(F.first("norm").alias("norm")).withColumn("norm", facts_of(F.col("norm")))
    left, right = one.select("component", F.col("sig").alias("s"), F.col("norm").alias("x")), one.select("component", F.col("sig").alias("t"), F.col("norm").alias("y"))
    return left.join(right, "component").where("s < t").where(held_rules(F.col("x"), F.col("y")) != 0).select("component", "s", "t")


def _merge(rows: list[tuple]) -> list[tuple]:
    """(row, cluster, confidence, reasons) of one component's (kind, a, b, s, t, level, score, detail).

    Kinds: row (a with signature s), edge (a, b), apart (a, b), clash (signatures s, t).
    """
    cluster, signs, edges = {}, {}, []
    clash, apart = defaultdict(set), defaultdict(set)
    for kind, a, b, s, t, level, score, detail in rows:
        if kind == "row":
            cluster[a], signs[a] = a, {s}
        elif kind == "edge":
            edges.append((-level, -score, a, b, detail))
        else:
            told, x, y = (apart, a, b) if kind == "apart" else (clash, s, t)
            told[x].add(y)
            told[y].add(x)
    members = {r: {r} for r in cluster}
    inside: dict[int, list] = defaultdict(list)
    for edge in sorted(edges):
        level, _, a, b, _ = edge
        p, q = cluster[a], cluster[b]
        if p != q:
            small, big = sorted((p, q), key=lambda c: (len(members[c]), -c))
            if level > -3 and any(not signs[big].isdisjoint(clash[s]) for s in signs[small]):
                continue
            if any(not members[big].isdisjoint(apart[r]) for r in members[small]):
                continue
            cluster.update(dict.fromkeys(members[small], big))
            members[big] |= members.pop(small)
            signs[big] |= signs.pop(small)
            inside[big] += inside.pop(small, [])
            p = big
        inside[p].append(edge)
    out = []
    for c, held in members.items():
        if len(held) > 1:
            levels = {-e[0] for e in inside[c]}
            confidence = "reviewed" if levels == {3} else "high" if levels <= {2, 3} else "medium"
            reasons = list(dict.fromkeys(e[4] for e in sorted(inside[c])))[:3]
            out += [(r, min(held), confidence, reasons) for r in held]
    return out


def _masks(pairs: list[tuple], bit: Callable[[int], int]) -> dict[int, int]:
    """For each bit the bits that it may not stand with."""
    told: dict[int, int] = defaultdict(int)
    for x, y in pairs:
        told[bit(x)] |= 1 << bit(y)
        told[bit(y)] |= 1 << bit(x)
    return told


def _merge_chunks(rows: list[tuple]) -> list[tuple]:
    """As _merge, of one component's (kind, u, v, members, marks, level, score, detail), with the same groups.

    Kinds: chunk (its number u, signature v, members and their marks), edge (u to v: each
    member of u with the larger ones of v), apart (marks u, v), clash (signatures u, v).
    Edges of one strength are taken by row: what a row meets are clusters, in the order of
    their first row, and one that is refused stays refused while both grow.
    """
    chunks, adjacent, strengths = {}, defaultdict(dict), defaultdict(lambda: defaultdict(list))
    pairs: dict[str, list] = {"apart": [], "clash": []}
    for kind, u, v, members, marks, level, score, detail in rows:
        if kind == "chunk":
            chunks[u] = (v, members, marks)
        elif kind == "edge":
            adjacent[u][v] = (-level, -score, detail)
            strengths[-level, -score][u].append(v)
        else:
            pairs[kind].append((u, v))
    mark_bits, sign_bits = defaultdict(lambda: len(mark_bits)), defaultdict(lambda: len(sign_bits))
    apart, clash = _masks(pairs["apart"], mark_bits.__getitem__), _masks(pairs["clash"], sign_bits.__getitem__)
    number = np.unique(np.concatenate([np.array(m, dtype=np.int64) for _, m, _ in chunks.values()]))
    at = {u: np.searchsorted(number, np.unique(np.array(m, dtype=np.int64))) for u, (_, m, _) in chunks.items()}
    n = len(number)
    cluster, chunk_of = np.arange(n), [0] * n
    marks_of, apart_of, signs_of, clash_of = [0] * n, [0] * n, [0] * n, [0] * n
    for u, (sign, members, marks) in chunks.items():
        s = sign_bits[sign]
        for i, mark in zip(np.searchsorted(number, members).tolist(), marks, strict=True):
            m = mark_bits[mark]
            chunk_of[i], marks_of[i], apart_of[i], signs_of[i], clash_of[i] = u, 1 << m, apart.get(m, 0), 1 << s, clash.get(s, 0)
    held = {i: [i] for i in range(n)}
    for strength in sorted(strengths):
        near = strengths[strength]
        met = {u: np.sort(np.concatenate([at[v] for v in vs])) for u, vs in near.items()}
        own = np.concatenate([at[u] for u in near])
        whose = np.repeat(np.array(list(near), dtype=np.int64), [len(at[u]) for u in near])
        order = np.argsort(own, kind="stable")
        for a, u in zip(own[order].tolist(), whose[order].tolist(), strict=True):
            p = int(cluster[a])
            seen = {p}
            for q in dict.fromkeys(cluster[met[u][np.searchsorted(met[u], a, "right") :]].tolist()):
                if q in seen or apart_of[p] & marks_of[q] or (strength[0] > -3 and clash_of[p] & signs_of[q]):
                    continue
                seen.add(q)
                small, big = sorted((p, q), key=lambda c: len(held[c]))
                cluster[held[small]] = big
                held[big] += held.pop(small)
                for bits in (marks_of, apart_of, signs_of, clash_of):
                    bits[big] |= bits[small]
                p = big
    out = []
    for members in held.values():
        if len(members) > 1:
            members.sort()
            inside = defaultdict(list)
            for i in members:
                inside[chunk_of[i]].append(i)
            edges = []  # of each pair of chunks the first pair of rows in this cluster
            for u, rows_u in inside.items():
                for v in inside.keys() & adjacent[u].keys():
                    level, score, detail = adjacent[u][v]
                    b = bisect_right(inside[v], rows_u[0])
                    if b < len(inside[v]):
                        edges.append((level, score, rows_u[0], inside[v][b], detail))
            levels = {-e[0] for e in edges}
            confidence = "reviewed" if levels == {3} else "high" if levels <= {2, 3} else "medium"
            reasons = list(dict.fromkeys(e[4] for e in sorted(edges)))[:3]
            found = number[members].tolist()
            out += [(r, found[0], confidence, reasons) for r in found]
    return out


def _agglomerate(batches, merge=_merge):
    """Components one after the other, from rows sorted by component."""
    last, held = None, []

    def done(rows: list[tuple]):
        found = merge(rows) if rows else []
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], names=["row", "cluster", "confidence", "reasons"])

    for batch in batches:
        for component, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != last:
                yield from done(held)
                last, held = component, []
            held.append(tuple(row))
    yield from done(held)


def members_of(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, cluster, confidence, reasons) of the rows in groups; cluster is the smallest row.

    pairs as from verdicts(); of items, row and norm are read.
    """
    same = pairs.where(F.col("verdict") == "same")
    parts = components(same, "a", "b").withColumnRenamed("node", "row")
    norm = F.struct(*(F.col(f"norm.{f}").alias(f) for f in READ))
    placed = items.select(F.col("row").cast("long").alias("row"), norm.alias("norm")).join(parts, "row")
    placed = placed.withColumn("sig", signature(F.col("norm")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = placed.select("component", F.lit("row").alias("kind"), F.col("row").alias("a"), none("long").alias("b"), F.col("sig").alias("s"), none("long").alias("t"), none("int").alias("level"), none("double").alias("score"), none("string").alias("detail"))
    where = parts.select(F.col("row").alias("a"), "component")
    edge = same.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), strength(F.col("confidence")).alias("level"), "score", "detail").join(where, "a")
    edge = edge.select("component", F.lit("edge").alias("kind"), "a", "b", none("long").alias("s"), none("long").alias("t"), "level", "score", "detail")
    told = pairs.where((F.col("verdict") == "different") & F.col("source").isin("ai", "review")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    told = told.join(where, "a").join(where.select(F.col("a").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    told = told.select("component", F.lit("apart").alias("kind"), "a", "b", *(none(k).alias(n) for n, k in (("s", "long"), ("t", "long"), ("level", "int"), ("score", "double"), ("detail", "string"))))
    clash = signature_conflicts(placed.select("component", "sig", "norm"))
    clash = clash.select("component", F.lit("clash").alias("kind"), none("long").alias("a"), none("long").alias("b"), "s", "t", none("int").alias("level"), none("double").alias("score"), none("string").alias("detail"))
    whole = rows.unionByName(edge).unionByName(told).unionByName(clash)
    dealt = whole.select("component", "kind", "a", "b", "s", "t", "level", "score", "detail").repartition("component").sortWithinPartitions("component")
    return dealt.mapInArrow(_agglomerate, MEMBERS)


def members_of_chunks(judged: DataFrame, texts: DataFrame, mark: Callable[[Column], Column] = lambda row: row, told: DataFrame | None = None) -> DataFrame:
    """members_of() for chunks of rows: judged(xs, ys, ...) as from verdicts() of met(), texts(members, norm).

    Rows whose marks are a pair of told(x, y) never share a group, as if each such pair
    had been called different; without told nothing is.  No pair of rows is made.
    """
    spark = judged.sparkSession
    first = lambda c: F.get(c, F.lit(0))
    same = judged.where("verdict = 'same'").select(first("xs").alias("u"), first("ys").alias("v"), strength(F.col("confidence")).alias("level"), "score", "detail")
    same = written(same, "same")
    linked = same.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    parts = components(same, "u", "v").withColumnRenamed("node", "u")
    where = linked.join(parts, "u", "left").select("u", F.coalesce("component", "u").alias("component"))  # a chunk may be linked with itself alone
    norm = F.struct(*(F.col(f"norm.{f}").alias(f) for f in READ))
    placed = texts.select(first("members").alias("u"), "members", norm.alias("norm")).join(where, "u").withColumn("sig", signature(F.col("norm")))
    none = lambda kind: F.lit(None).cast(kind)
    longs, unsaid = "array<long>", [none(k).alias(c) for c, k in (("level", "int"), ("score", "double"), ("detail", "string"))]
    rows = placed.select("component", F.lit("chunk").alias("kind"), "u", F.col("sig").alias("v"), "members", F.transform("members", lambda r: mark(r).cast("long")).alias("marks"), *unsaid)
    bare = lambda kind: [F.lit(kind).alias("kind"), "u", "v", none(longs).alias("members"), none(longs).alias("marks")]
    whole = rows.unionByName(same.join(where, "u").select("component", *bare("edge"), "level", "score", "detail"))
    clash = signature_conflicts(placed.select("component", "sig", "norm")).select("component", F.col("s").alias("u"), F.col("t").alias("v"))
    whole = whole.unionByName(clash.select("component", *bare("clash"), *unsaid))
    if told is not None:
        marks = rows.select("component", F.explode("marks").alias("u")).distinct()
        apart = told.select(F.col("x").cast("long").alias("u"), F.col("y").cast("long").alias("v")).join(marks, "u").join(marks.withColumnRenamed("u", "v"), ["component", "v"], "left_semi")
        whole = whole.unionByName(apart.select("component", *bare("apart"), *unsaid))
    dealt = whole.select("component", "kind", "u", "v", "members", "marks", "level", "score", "detail").repartition(alike.tasks(spark), "component").sortWithinPartitions("component")
    return dealt.mapInArrow(partial(_agglomerate, merge=_merge_chunks), MEMBERS)


def complete(norm: Column, code: Column) -> Column:
    """How many of brand, part number, cost, stock and code a row has."""
    held = [norm["brand"], norm["part_base"], code]
    known = sum(F.coalesce((c != "").cast("int"), F.lit(0)) for c in held)
    return known + norm["unit_cost"].isNotNull().cast("int") + norm["stock"].isNotNull().cast("int")


def master_order(norm: Column, code: Column, row: Column) -> list[Column]:
    """The most complete row first, then most stock in single pieces, then one with a code, then the smallest row."""
    pieces = F.coalesce(norm["stock"], F.lit(0.0)) * F.coalesce(norm["pack"], F.lit(1))
    return [complete(norm, code).desc(), pieces.desc(), F.coalesce((code != ""), F.lit(False)).desc(), row.asc()]


def with_roles(members: DataFrame, items: DataFrame) -> DataFrame:
    """members with role master or duplicate, and the row's norm, code, name and unit."""
    full = members.join(items.select(F.col("row").cast("long").alias("row"), "norm", "code", "name", "unit"), "row")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(*master_order(F.col("norm"), F.col("code"), F.col("row"))))
    return full.withColumn("role", F.when(rank == 1, "master").otherwise("duplicate"))


def labels(groups: DataFrame) -> DataFrame:
    """(cluster, label): G-0001 for the group with the smallest first row, and so on.

    Numbers come from a range-wise count, not from one global window.
    """
    heads = groups.select("cluster").distinct()
    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = heads.select(F.percentile_approx("cluster", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in sorted(set(bounds)))), lambda b: b < F.col("cluster"))) if bounds else F.lit(0)
    dealt = heads.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("cluster")) + F.col("before")
    number = n.cast("string")
    padded = F.when(F.char_length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return dealt.join(F.broadcast(offset), "part").select("cluster", F.concat(F.lit("G-"), padded).alias("label"))  # offset: a row for each part


def best_between(placed: DataFrame) -> DataFrame:
    """The most alike of the pairs(a, b, score, ca, cb) between any two clusters ca and cb; pairs inside one are left out."""
    rank = F.row_number().over(Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("score"), "a", "b"))
    return placed.where("ca <> cb").withColumn("rank", rank).where("rank = 1").drop("rank")


def one_per_cluster_pair(pairs: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """The most alike pair between any two clusters (rows outside groups are their own); pairs inside one are left out."""
    place = members.select(F.col("row").alias("at"), "cluster")
    a, b = place.select(F.col("at").alias("a"), F.col("cluster").alias("ca")), place.select(F.col("at").alias("b"), F.col("cluster").alias("cb"))
    full = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ca": F.coalesce("ca", F.col("a").cast("long")), "cb": F.coalesce("cb", F.col("b").cast("long"))})
    best = best_between(full).select(*pairs.columns)
    return best.orderBy(F.desc("score"), "a", "b").limit(most) if most else best

