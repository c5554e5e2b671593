"""The whole analysis: items to groups, look-alikes, pairs to review, figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, decisions, figures, reviewer
from ..operators.candidates import candidate_pairs
from ..operators.compare import compare
from ..sources.sinks import added_columns
from ..sources.tables import written

MAX_UNSURE = 5000


@dataclass
class Analysis:
    """DataFrames of one run; all lazy but the written ones."""

    items: DataFrame
    pairs: DataFrame
    members: DataFrame
    lookalikes: DataFrame
    unsure: DataFrame
    currencies: list[str]

    def figures(self) -> DataFrame:
        m = self.members
        return figures.group_figures(m.select("cluster", "role", "unit", *(F.col(f"norm.{k}").alias(k) for k in ("stock", "pack", "unit_cost"))), money_ok=len(self.currencies) <= 1)

    def groups(self) -> DataFrame:
        """(cluster, label, size, master, confidence, reasons, name_standard, figures...), one row for each group."""
        base = self.members.groupBy("cluster", "label", "confidence", "reasons").agg(F.count("*").alias("size"), F.max(F.when(F.col("role") == "master", F.col("row"))).alias("master"))
        return base.join(figures.standard_names(self.members), "cluster").join(self.figures(), "cluster")

    def headline(self) -> DataFrame:
        return figures.headline(self.figures())

    def summary(self) -> DataFrame:
        """One row of counts."""
        m = self.members.agg(F.countDistinct("cluster").alias("groups"), F.count("*").alias("grouped_rows"))
        n = self.items.agg(F.count("*").alias("items"))
        p = self.pairs.agg(F.count("*").alias("pairs_compared"))
        near, open_ = self.lookalikes.agg(F.count("*").alias("lookalikes")), self.unsure.agg(F.count("*").alias("needs_review"))
        one = n.crossJoin(p).crossJoin(m).crossJoin(near).crossJoin(open_)  # one row each
        return one.select("items", "pairs_compared", "groups", (F.col("grouped_rows") - F.col("groups")).alias("duplicate_lines"), "lookalikes", "needs_review")

    def export(self) -> DataFrame:
        """The added columns of every item."""
        g = self.groups().select("cluster", "name_standard", "stock_total", "value_on_duplicates")
        members = self.members.select("row", "cluster", "role", "label", "confidence", "reasons").join(g, "cluster").drop("cluster")
        return added_columns(self.items.select("row", "code", "norm", F.lit(True).alias("analysed")), members, self.lookalikes, self.unsure)


def analyse(items: DataFrame, log: DataFrame | None = None, make_reviewer: Callable[[], reviewer.Reviewer] | None = None, max_reviews: int = 0, currency: str = "GBP", max_unsure: int = MAX_UNSURE) -> Analysis:
    """items as from plans.catalogue.items_of; log is a decision log, replayed in full.

    The list of pairs to review is a top-k report of max_unsure pairs, best first.
    """
    items = written(items, "items")
    wanted = candidate_pairs(items.select("row", "norm", "tokens"))
    decided = decisions.present(decisions.decided_pairs(log), items) if log is not None else None
    if decided is not None:
        wanted = wanted.union(decided.select("a", "b")).distinct()
    pairs = compare(wanted, items.select("row", "norm", "tokens", "trigrams"))
    if decided is not None:
        pairs = decisions.with_decisions(pairs, decided)
    pairs = written(pairs, "pairs")
    if make_reviewer is not None and max_reviews > 0:
        answers = written(reviewer.reviewed(pairs.where("verdict = 'unsure'"), items, make_reviewer, max_reviews), "answers")
        pairs = written(reviewer.with_answers(pairs, answers, items), "settled")
    members = cluster.with_roles(cluster.members_of(pairs, items), items)
    if log is not None:
        members = decisions.reapplied(members, log)
    members = written(members, "members")
    members = members.join(cluster.labels(members), "cluster")
    lookalikes = cluster.one_per_cluster_pair(pairs.where("verdict = 'different' and lookalike"), members)
    unsure = cluster.one_per_cluster_pair(pairs.where("verdict = 'unsure'"), members, max_unsure)
    found = figures.currencies(items.select(F.col("norm.unit_cost").alias("unit_cost"), F.col("norm.currency").alias("currency")), currency).first()[0]
    return Analysis(items, pairs, members, lookalikes, unsure, list(found))
