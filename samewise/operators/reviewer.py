"""A pluggable reviewer for unsure pairs, with a cache of its answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import LOOKALIKE

VERDICTS = ("same", "different", "unsure")
REASON_CAP, BATCH = 200, 20
ANSWER = "a long, b long, answer string, answer_reason string"


class Reviewer(Protocol):
    """Settles pairs: for each (x, y) of shared fields, a verdict and a reason."""

    def review(self, pairs: list[tuple[dict, dict]]) -> list[tuple[str, str]]: ...


def item_fields(norm: Column) -> Column:
    """All that a reviewer learns about an item: name, brand, part number, variant, kind, sizes."""
    text = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    sizes = F.to_json(norm["dims"].dropFields("poles"))
    return F.struct(
        F.substring(norm["text"], 1, 300).alias("name"),
        F.upper(norm["brand"]).alias("brand"),
        text(F.upper(norm["part_base"])).alias("part_number"),
        text(F.upper(F.array_join(norm["variants"], "/"))).alias("variant"),
        text(F.array_join(norm["types"], ", ")).alias("kind"),
        F.when(sizes != "{}", sizes).alias("sizes"),
    )


def cache_key(x: Column, y: Column, version: str) -> Column:
    """SHA-256 over the version and both sides' fields, in one order whichever comes first."""
    a, b = F.to_json(item_fields(x)), F.to_json(item_fields(y))
    return F.sha2(F.to_json(F.array(F.lit(version), F.least(a, b), F.greatest(a, b))), 256)


def parse_answers(reply: str, count: int) -> list[tuple[str, str]]:
    """Answers in pair order from a JSON reply {"answers": [{"pair", "verdict", "reason"}]}; what is missing or malformed stays unsure."""
    out = [("unsure", "Not reviewed.")] * count
    try:
        answers = json.loads(reply)["answers"]
    except (ValueError, KeyError, TypeError):
        return out
    for a in answers if isinstance(answers, list) else []:
        if isinstance(a, dict) and isinstance(a.get("pair"), int) and 1 <= a["pair"] <= count and a.get("verdict") in VERDICTS and isinstance(a.get("reason"), str):
            out[a["pair"] - 1] = (a["verdict"], " ".join(a["reason"].split())[:REASON_CAP] or "Checked by the reviewer.")
    return out


def reviewed(unsure: DataFrame, items: DataFrame, make: Callable[[], Reviewer], most: int, batch: int = BATCH) -> DataFrame:
    """(a, b, answer, answer_reason) for the ``most`` unsure pairs with the best scores.

    The reviewer is made on the executor and asked in batches; a batch that fails stays unsure.
    """
    top = unsure.orderBy(F.desc("score"), "a", "b").limit(most)
    sides = items.select(F.col("row").cast("long").alias("row"), F.to_json(item_fields(F.col("norm"))).alias("fields"))
    asked = top.select("a", "b").join(sides.select(F.col("row").alias("a"), F.col("fields").alias("x")), "a").join(sides.select(F.col("row").alias("b"), F.col("fields").alias("y")), "b")

    def ask(frames: Iterable[pd.DataFrame]):
        reviewer = make()
        for frame in frames:
            found: list[tuple[str, str]] = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    found += reviewer.review([(json.loads(x), json.loads(y)) for x, y in zip(part.x, part.y, strict=True)])
                except Exception:  # one failed batch must not lose the run
                    found += [("unsure", "Not reviewed.")] * len(part)
            yield pd.DataFrame({"a": frame.a, "b": frame.b, "answer": [v for v, _ in found], "answer_reason": [r for _, r in found]})

    return asked.select("a", "b", "x", "y").mapInPandas(ask, ANSWER)


def from_cache(pairs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, to do): pairs(key, ...) found in cache(key, answer, answer_reason), and the others."""
    return pairs.join(cache, "key"), pairs.join(cache, "key", "left_anti")


def with_answers(verdicts: DataFrame, answers: DataFrame, items: DataFrame) -> DataFrame:
    """Unsure verdicts settled by answers: same is of medium confidence, different is hard and may be a look-alike."""
    part = items.select(F.col("row").cast("long").alias("row"), F.col("norm.part_base").alias("part"))
    df = verdicts.join(answers, ["a", "b"], "left").join(part.select(F.col("row").alias("a"), F.col("part").alias("pa")), "a", "left").join(part.select(F.col("row").alias("b"), F.col("part").alias("pb")), "b", "left")
    open_ = F.col("verdict") == "unsure"
    same, apart = F.coalesce(open_ & (F.col("answer") == "same"), F.lit(False)), F.coalesce(open_ & (F.col("answer") == "different"), F.lit(False))
    alike = (F.col("score") >= LOOKALIKE) | F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    pick = lambda a, b, c: F.when(same, a).when(apart, b).otherwise(F.col(c)).alias(c)
    return df.select("a", "b", pick("same", "different", "verdict"), pick("ai_same", "ai_different", "reason"), pick(F.col("answer_reason"), F.col("answer_reason"), "detail"), "score", pick("medium", F.lit(None), "confidence"), F.when(apart, alike).otherwise(F.col("lookalike")).alias("lookalike"), pick("ai", "ai", "source"), F.when(apart, True).otherwise(F.col("hard")).alias("hard"))
