"""Choosing and ordering segments: expiry, visibility, exact copies, decay, diversity, caps, priority order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.sources.ingest import priority_weight

REQUEST = "request_id"


def _value(name: str) -> Column:
    """A score of 0 counts as absent."""
    return F.when(F.col(name) != 0, F.col(name))


def score() -> Column:
    return F.coalesce(_value("rerank_score"), _value("score"), F.lit(0.0))


def expired(current_turn: Column | int) -> Column:
    return F.col("ttl").isNotNull() & (F.lit(current_turn) - F.coalesce("turn", F.lit(0)) >= F.col("ttl"))


def drop_expired(df: DataFrame, current_turn: int) -> DataFrame:
    return df.filter(~expired(current_turn))


def visible_to(namespace: Column | str) -> Column:
    namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.col("visibility").isin("ALL", "GLOBAL", "DOWNSTREAM", "CURRENT_TURN") | (F.col("visibility").isin("NAMESPACE", "AGENT_ONLY") & (F.col("namespace") == namespace))


def drop_hidden(df: DataFrame, namespace: str = "default") -> DataFrame:
    return df.filter(visible_to(namespace))


def content_hash(text: str = "content") -> Column:
    return F.substring(F.md5(F.col(text).cast("binary")), 1, 16)


def drop_copies(df: DataFrame) -> DataFrame:
    """The first of equal contents in a request stays, whatever its type."""
    order = Window.partitionBy(REQUEST, "content_hash").orderBy("pos")
    return df.withColumn("content_hash", content_hash()).withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy", "content_hash")


def decay(df: DataFrame, current_turn: int, rate: float = 0.1, least: float = 0.1) -> DataFrame:
    """Scores fall with age in turns; a turn in the future raises them."""
    base = F.coalesce(_value("rerank_score"), _value("score"), F.lit(0.5))
    age = F.lit(current_turn) - F.coalesce("turn", F.lit(0))
    return df.withColumn("rerank_score", base * F.greatest(F.lit(least), F.exp(-rate * age)))


def cap_types(df: DataFrame, most: int) -> DataFrame:
    """At most `most` segments of each type in a request, in order; locked ones always stay, and count.

    Kept unlocked ones before a row are all that came before it as long as the cap isn't met, so the row stays exactly
    if fewer than `most` rows of its type precede it: a window count, no loop."""
    before = Window.partitionBy(REQUEST, "type").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.count("*").over(before)).filter(F.col("locked") | (F.col("before") < most)).drop("before")


def order(df: DataFrame) -> DataFrame:
    """Locked segments first in their order, then by priority and score; pos is numbered anew."""
    by = Window.partitionBy(REQUEST).orderBy(F.desc("locked"), F.when(F.col("locked"), 0).otherwise(-priority_weight()), F.when(F.col("locked"), 0.0).otherwise(-score()), "pos")
    return df.withColumn("new_pos", F.row_number().over(by) - 1).drop("pos").withColumnRenamed("new_pos", "pos")


def grams_of(text: str, n: int = 3) -> set[str]:
    return set() if not text else {text} if len(text) < n else {text[i : i + n] for i in range(len(text) - n + 1)}


def similarity(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def select_diverse(contents: list[str], scores: list[float], locked: list[bool], weight: float = 0.7, threshold: float = 0.85, most: int | None = 500) -> list[int]:
    """Places in order of selection: locked ones first, then by weighted relevance less the greatest similarity to those
    selected; what is too similar to a selected one is never taken.  Over `most` segments all are kept as they are; None
    is no such limit."""
    n = len(contents)
    free = [i for i in range(n) if not locked[i]]
    fixed = [i for i in range(n) if locked[i]]
    if most is not None and n > most or not free:
        return list(range(n))
    grams = {i: grams_of(contents[i]) for i in free}
    left = sorted(free, key=lambda i: (-scores[i], i))
    chosen = [left.pop(0)]
    nearest = {i: similarity(grams[i], grams[chosen[0]]) for i in left}
    while left:
        left = [i for i in left if nearest[i] <= threshold]
        if not left:
            break
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * nearest[i], -i))
        left.remove(best)
        chosen.append(best)
        for i in left:
            nearest[i] = max(nearest[i], similarity(grams[i], grams[best]))
    return fixed + chosen


def diversify(df: DataFrame, weight: float = 0.7, threshold: float = 0.85, most: int | None = 500) -> DataFrame:
    """Maximal marginal relevance within each request; only keys travel back, texts stay in Spark.  Requests of over
    `most` segments stay as they are and don't go to Python at all; with None all are compared."""
    df = df.withColumn("pos", F.col("pos").cast("int"))
    slim = df.select(REQUEST, "pos", "content", score().alias("s"), "locked")
    large = df.limit(0).select(REQUEST)
    if most is not None:
        large = df.groupBy(REQUEST).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(REQUEST)
        slim = slim.join(large, REQUEST, "left_anti")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        at = select_diverse(pdf["content"].tolist(), pdf["s"].tolist(), pdf["locked"].tolist(), weight, threshold, most)
        out = pdf.iloc[at][[REQUEST, "pos"]].copy()
        out["new_pos"] = np.arange(len(at), dtype=np.int32)
        return out

    kind = df.schema[REQUEST].dataType.simpleString()
    picked = slim.groupBy(REQUEST).applyInPandas(pick, f"{REQUEST} {kind}, pos int, new_pos int")
    chosen = df.join(picked, [REQUEST, "pos"]).drop("pos").withColumnRenamed("new_pos", "pos")
    return chosen if most is None else chosen.unionByName(df.join(large, REQUEST, "left_semi"))
