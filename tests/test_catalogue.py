"""Attributes, verdicts, clustering and figures of catalogues."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from samewise.functions import attributes as at
from samewise.functions import text as tx
from samewise.operators import cluster, compare, decisions, evaluate, figures, reviewer
from samewise.operators.components import components
from samewise.plans import analysis, catalogue

SAME = [
    ("SKF 6205-2RS Deep Groove Ball Bearing", "6205 2RS SKF bearing"),
    ("SKF 6205-2RS Deep Groove Ball Bearing", "رولمان بلي ٦٢٠٥ ٢ار اس اس كي اف"),
    ("SKF 6205-2RS bearing", "BRG 62052RS skf"),
    ("Hex bolt M8x25 A2 SS", "M8 X 25MM HEX HD BOLT STAINLESS A2"),
    ("Shell Gadus S2 V220 2 Grease 18 KG Pail", "Shell Gadus S2 V220 2 grease 400gm cartridge"),
    ("LED flood light 100W IP65", "LED floodlight 100 W 220V IP65"),
    ("MCB 16A single pole", "Circuit breaker MCB 16A 1P"),
]
DIFFERENT = [
    ("SKF 6205-2RS bearing", "SKF 6205-ZZ bearing", "seal_differs"),
    ("SKF 6205-2RS bearing", "SKF 6205-2RS/C3 bearing", "clearance_differs"),
    ("SKF 6205-2RS bearing", "SKF 6205-2RS1 bearing", "variant_spelling"),
    ("SKF 6205-2RS bearing", "FAG 6205-2RS bearing", "brand_equivalent"),
    ("SKF 6205-2RS bearing", "SKF 6206-2RS bearing", "part_differs"),
    ("Shell Gadus S2 V220 2 grease", "Shell Gadus S2 V220 3 grease", "number_differs"),
    ("شحم شل جادوس في٢٢٠ ٢", "زيت تروس شل ٢٢٠", "type_differs"),
    ("3M safety helmet white H-700", "3M safety helmet yellow H-700", "colour_differs"),
    ("LED flood light 100W IP65", "LED flood light 150W IP65", "power_differs"),
    ("Hex bolt M8x25 A2", "Hex bolt M8x25 A4", "material_differs"),
    ("Hex bolt M8x25 A2", "Hex bolt M8x30 A2", "size_differs"),
    ("MCB 16A single pole", "MCB 20A single pole", "current_differs"),
    ("MCB 16A single pole", "MCB 16A double pole", "poles_differ"),
    ("Safety shoes S3 size 42", "Safety shoes S1P size 42", "code_differs"),
]
UNSURE = [("SKF 6205 bearing", "SKF 6205-2RS bearing"), ("Gloves nitrile sz 9", "قفاز نيتريل مقاس ٩")]


def items(spark, rows, schema="row long, name string"):
    return catalogue.items_of(spark.createDataFrame(rows, schema))


def test_truth_tables(spark):
    pairs = [(x, y, "same") for x, y in SAME] + DIFFERENT + [(x, y, "unsure") for x, y in UNSURE]
    rows = [(2 * i + k, n) for i, p in enumerate(pairs) for k, n in enumerate(p[:2])]
    ab = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long")
    for r in compare.compare(ab, items(spark, rows)).collect():
        wanted = pairs[r.a // 2][2]
        assert wanted in (r.verdict, r.reason), (pairs[r.a // 2], r)
        assert r.detail and r.hard == (wanted not in ("same", "unsure"))


def test_chains_never_join_conflicts(spark):
    rows = [(2, "SKF 6205-2RS deep groove bearing"), (3, "SKF 6205-2RS deep groove ball bearing"), (4, "SKF 6205-ZZ deep groove ball bearing"), (5, "SKF 6205-ZZ deep groove bearing")]
    found = analysis.analyse(items(spark, rows))
    assert {(r.row, r.cluster) for r in found.members.collect()} == {(2, 2), (3, 2), (4, 4), (5, 4)}
    assert found.lookalikes.count() == 1 and found.summary().first().duplicate_lines == 2
    sample = found.export().orderBy("row").collect()
    assert [r.dedupe_role for r in sample].count("master") == 2


def _pairs(spark, rows):
    return spark.createDataFrame([(a, b, v, "r", f"d{a}{b}", s, c, False, src, False) for a, b, v, s, c, src in rows], "a long, b long, verdict string, reason string, detail string, score double, confidence string, lookalike boolean, source string, hard boolean")


def test_decisions_bound_clusters(spark):
    it = items(spark, [(i, "plain thing") for i in range(6)])  # no attributes, so only decisions tell them apart
    rows = [(0, 1, "same", 0.9, "medium", "text"), (1, 2, "same", 0.8, "high", "rule"), (2, 3, "same", 0.7, "medium", "text"), (0, 3, "different", 0.1, None, "review"), (4, 5, "same", 0.0, "reviewed", "review")]
    got = {r.row: (r.cluster, r.confidence) for r in cluster.members_of(_pairs(spark, rows), it).collect()}
    assert got == {0: (0, "medium"), 1: (0, "medium"), 2: (0, "medium"), 4: (4, "reviewed"), 5: (4, "reviewed")}


def test_components_of_random_graphs(spark):
    import random

    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    expected = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize(
    ("name", "base", "variants"),
    [
        ("SKF 6205-2RS", "6205", ["2rs"]),
        ("62052RSC3", "6205", ["2rs", "c3"]),
        ("6202Z", "620", ["2z"]),
        ("Box of 1000 nuts", None, []),
        ("oil 209 L", None, []),
        ("bolt M8x25", None, []),
        ("H-700 helmet", "700", []),
    ],
)
def test_part_numbers(name, base, variants):
    got = at.read_part("", name)
    assert (got[0], got[2]) == (base, variants)


def test_part_column_first():
    assert at.read_part("6205 C3 XYZ", "bearing 6205-2RS")[:3] == ("6205", "column", ["c3", "2rs"])
    assert at.read_part("6205 C3 XYZ", "")[4] == ["xyz"]


def test_numbers_packs_scripts_and_safe_text(spark):
    texts = ["£4.20", "1,250", "4,20", "(12.50)", "12 GBP", "n/a", "", "12d", "nan", "1e5", "٥"]
    got = [tuple(r.n) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(at.parse_number(F.col("t")).alias("n")).collect()]
    assert got == [(4.2, "GBP", True), (1250.0, None, True), (4.2, None, True), (-12.5, None, True), (12.0, "GBP", True), (None, None, False), (None, None, True), (None, None, False), (None, None, False), (None, None, False), (5.0, None, True)]
    packs = ["Box of 10", "10/pk", "25 pcs", "pack 1", "no pack", "box of 99999999"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in packs], "t string").select(at.parse_pack(tx.fold(F.col("t")))).collect()][:5] == [10, 10, 25, None, None]
    scripts = ["abc", "بلي", "abc بلي بلي بلي", "abc بلي", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in scripts], "t string").select(tx.script_of(F.col("t"))).collect()] == ["latin", "arabic", "arabic", "mixed", "latin", "latin"]
    cells = ["=1+1", "-5", "-5.20", "-x", "+44", "@a", "a", None, "\tx"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in cells], "t string").select(tx.csv_safe(F.col("t"))).collect()] == ["'=1+1", "-5", "-5.20", "'-x", "'+44", "'@a", "a", "", "'\tx"]


def test_spelled_brand_and_blanks(spark):
    got = {r.name: r.norm for r in items(spark, [(1, "ess kay eff bearing"), (2, "  \t"), (3, None), (4, "Straße 9.")]).collect()}
    assert set(got) == {"ess kay eff bearing", "Straße 9."}
    assert got["ess kay eff bearing"].brand == "skf" and got["Straße 9."].text == "strasse 9"


def test_figures_by_hand(spark):
    rows = [(1, "master", 10.0, None, "each", 2.0), (1, "duplicate", 4.0, 5, "box", 10.0), (1, "duplicate", -3.0, None, "", 3.0), (2, "master", 1.0, None, "m", 1.0), (2, "duplicate", 2.0, None, "kg", None), (3, "master", None, None, None, None), (3, "duplicate", None, None, None, 5.0)]
    m = spark.createDataFrame(rows, "cluster long, role string, stock double, pack int, unit string, unit_cost double")
    got = {r.cluster: tuple(r)[1:] for r in figures.group_figures(m).collect()}
    assert got[1] == (30.0, 20.0, 40.0, 2.0, 3.0, False)
    assert got[2] == (None, None, 0.0, 1.0, 1.0, True)
    assert got[3] == (None, None, None, 5.0, 5.0, False)
    assert {r.cluster: r.value_on_duplicates for r in figures.group_figures(m, money_ok=False).collect()}[1] is None


def test_decision_log(spark):
    log = spark.createDataFrame([], decisions.LOG)
    for action, rows in (("same", [1, 2, 3]), ("different", [3, 1]), ("remove_row", [5, 6, 7]), ("same", [5, 6]), ("approve", [1, 2]), ("set_master", [2])):
        log = decisions.appended(log, action, rows)
    assert {(r.a, r.b): r.verdict for r in decisions.decided_pairs(log).collect()} == {(1, 2): "same", (1, 3): "different", (2, 3): "same", (5, 6): "same", (5, 7): "different"}
    members = spark.createDataFrame([(1, 1, "master", "high"), (1, 2, "duplicate", "high")], "cluster long, row long, role string, confidence string")
    got = {r.row: (r.role, r.confidence) for r in decisions.reapplied(members, log).collect()}
    assert got == {1: ("duplicate", "reviewed"), 2: ("master", "reviewed")}
    with pytest.raises(ValueError):
        decisions.appended(log, "same", [1])


class Always:
    def __init__(self, answer):
        self.answer = answer

    def review(self, pairs):
        return [(self.answer, "Checked.") for _ in pairs]


def test_reviewer(spark):
    it = items(spark, [(2, "SKF 6205 bearing"), (3, "SKF 6205-2RS bearing")])
    assert analysis.analyse(it).members.count() == 0
    yes = analysis.analyse(it, make_reviewer=lambda: Always("same"), max_reviews=10)
    assert yes.members.count() == 2 and yes.groups().first().reasons == ["Checked."]
    no = analysis.analyse(it, make_reviewer=lambda: Always("different"), max_reviews=10)
    assert no.members.count() == 0 and no.unsure.count() == 0 and no.lookalikes.first().reason == "ai_different"


def test_answers_are_checked():
    reply = '{"answers": [{"pair": 1, "verdict": "same", "reason": " a  b "}, {"pair": 9, "verdict": "same", "reason": "x"}, {"pair": 2, "verdict": "maybe", "reason": "x"}]}'
    assert reviewer.parse_answers(reply, 2) == [("same", "a b"), ("unsure", "Not reviewed.")]
    assert reviewer.parse_answers("no json", 1) == [("unsure", "Not reviewed.")]


def test_score(spark):
    ab = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert tuple(evaluate.score(ab([(1, 2), (3, 4)]), ab([(1, 2), (5, 6), (7, 8)])).first()) == (0.5, 1 / 3, 3, 2, 1)
    assert tuple(evaluate.score(ab([]), ab([])).first())[:2] == (1.0, 1.0)


def test_no_group_holds_a_conflict(spark, data):
    """Invariants of the whole analysis on the derived catalogue."""
    found = analysis.analyse(catalogue.items_of(catalogue.derived(spark, data), ascii_only=True))
    members = found.members.select("row", "cluster", "role").collect()
    groups = {}
    for r in members:
        groups.setdefault(r.cluster, []).append(r)
    assert len({r.row for r in members}) == len(members)
    assert all(sum(r.role == "master" for r in g) == 1 and len(g) > 1 and min(r.row for r in g) == c for c, g in groups.items())
    inside = [(min(a.row, b.row), max(a.row, b.row)) for g in groups.values() for a, b in combinations(g, 2)]
    if inside:
        checked = compare.compare(spark.createDataFrame(inside, "a long, b long"), found.items)
        assert checked.where("hard").count() == 0
    assert found.pairs.where("a >= b").count() == 0
