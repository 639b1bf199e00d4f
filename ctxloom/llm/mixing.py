"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size (source, size, documents).  A source whose target reaches its whole size takes
every document once; what its budget leaves is met by a second copy of some.  How many documents of each size those
are: first each size's share of the budget, rounded down; then the largest sizes that still fit, until about
dp_budget words are left; then a bounded knapsack by dynamic programming over that rest, which meets it exactly or as
nearly as the sizes allow.  Which documents of a size: those with the smallest seeded hashes.

No row is ranked beside all rows of its size: the hashes fall into BINS ranges, counted by (source, size, range), and
only the range in which a size's count ends is ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.llm.common import WORD, stage, table

#: Weights by the sources' places in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Words left to the dynamic programme.
DP_BUDGET = 1 << 16
#: Ranges of the seeded hash.
BINS = 1 << 12
#: Sources whose plan is made on the driver and broadcast; the plan of more stays distributed.
FEW = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """total shared by weight; none above cap times its size, the excess reshared by weight among the rest."""
    found = [0.0] * len(sizes)
    full: set[int] = set()
    while len(full) < len(sizes):
        rest = total - sum(found[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        share = {i: rest * w / weight for i, w in enumerate(weights) if i not in full}
        over = {i for i, x in share.items() if x > cap * sizes[i]}
        for i, x in share.items():
            found[i] = cap * sizes[i] if i in over else x
        if not over:
            break
        full |= over
    return found


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most counts) sum as near as can be to budget, not above it unless nothing fits.

    Bounded items are split in powers of two; for each sum the first item that reaches it is kept, so an item serves
    once along any way back."""
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return taken
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        left, k = int(counts[i]), 1
        if sizes[i] <= 0:
            continue
        while left > 0:
            k = min(k, left)
            step = int(sizes[i]) * k
            if step > budget:
                break
            new = np.zeros_like(reached)
            new[step:] = reached[:-step]
            new &= ~reached
            by[new] = len(items)
            reached |= new
            items.append((int(i), k))
            left, k = left - k, 2 * k
            if reached[budget]:
                break
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, k = items[by[at]]
        taken[i] += k
        at -= int(sizes[i]) * k
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each size to take for a budget of at most all of them."""
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    left_for_dp = min(budget, dp_budget)
    taken = np.floor(counts * ((budget - left_for_dp) / total)).astype(np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] > 0 and (more := min(int(counts[i] - taken[i]), (rest - left_for_dp) // int(sizes[i]))) > 0:
            taken[i] += more
            rest -= more * int(sizes[i])
    return taken + knapsack(sizes, counts - taken, rest)


def draws_of(seed: int) -> tuple[Column, Column]:
    """Two hashes that name a row by its id, source and text."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text"), F.xxhash64(F.lit(seed + 1), "text", "source", "doc_id")


def _weighed(per_source: DataFrame, weights) -> DataFrame:
    """per_source with each source's weight by its place in code-point order, null last: sorted ranges are counted, and
    a source's place is what came before its range and within it."""
    n = int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = per_source.repartitionByRange(n, *order).sortWithinPartitions(*order).select("source", "source_size", F.monotonically_increasing_id().alias("id"))
    ranged = stage(ranged.withColumn("part", F.shiftright("id", 33)), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "before")
    place = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ranged.join(counts, "part").select("source", "source_size", weight.alias("weight"))


def _spread_targets(per_source: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """As targets(), for any number of sources: each round sums what is full and what isn't, and only the sums travel.
    A source is full once the share of a weight of 1 passes cap times its size by its weight."""
    rows = stage(_weighed(per_source, weights), "weighed")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * level > cap * F.col("source_size")
        found = rows.agg(F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - found[0]) / found[1] if found[1] else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("weight") * level, cap * F.col("source_size")).alias("target"))


def plan_of(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, base, budget) of each source of rows (source, size): every document base times, and
    a second time documents of budget words."""
    per_source = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = per_source.limit(FEW + 1).collect()
    if len(few) > FEW:
        plan = _spread_targets(per_source, weights, share, cap)
    else:
        few.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
        whole = [r["source_size"] for r in few]
        goal = targets(whole, [weights[i % len(weights)] for i in range(len(whole))], share * sum(whole), cap)
        plan = rows.sparkSession.createDataFrame([(r["source"], s, t) for r, s, t in zip(few, whole, goal)], "source string, source_size long, target double")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("base", base.cast("int")).withColumn("budget", F.rint(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))
    return stage(plan, "plan") if len(few) > FEW else F.broadcast(plan)


def mix(docs: DataFrame, size: Column, seed: int = 17, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, draw, twin, copies): how often the mix takes each row of docs.

    A null source is a source of its own, the last.  Rows of size 0 (null, empty and wordless texts) are never taken; a
    long text is counted whole.  Equal rows may differ in copies, but their sum is fixed; reruns agree.  No rows: no
    rows.
    """
    draw, twin = draws_of(seed)
    rows = stage(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), twin.alias("twin")), "mix")
    plan = plan_of(rows, weights, share, cap)
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("docs"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["more"] = fit(pdf["size"].to_numpy(), pdf["docs"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pdf[["source", "size", "more"]]

    solved = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).select(counts["source"], "size", "docs", "budget").groupBy("source").applyInPandas(solve, "source string, size long, more long")
    binned = rows.withColumn("bin", F.pmod("draw", F.lit(BINS)))
    before = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = binned.groupBy("source", "size", "bin").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    ends = ends.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "bin", "here", "before")
    at = ends.join(solved.select(F.col("source").alias("s3"), F.col("size").alias("z3"), "more"), F.col("s2").eqNullSafe(F.col("s3")) & (F.col("z2") == F.col("z3")))
    quota = at.select("s2", "z2", F.col("bin").alias("b2"), F.greatest(F.lit(0), F.least("here", F.col("more") - F.col("before"))).alias("quota"), "here")
    dealt = binned.join(quota, binned["source"].eqNullSafe(F.col("s2")) & (binned["size"] == F.col("z2")) & (binned["bin"] == F.col("b2")), "left")
    split = Window.partitionBy("source", "size", "bin").orderBy("draw", "twin")
    chosen = dealt.withColumn("more", (F.row_number().over(split) <= F.col("quota")).cast("int"))
    return chosen.join(plan.withColumnRenamed("source", "s4"), chosen["source"].eqNullSafe(F.col("s4"))).select("doc_id", "source", "size", "source_size", "target", "draw", "twin", F.when(F.col("size") > 0, F.col("base") + F.coalesce("more", F.lit(0))).otherwise(0).alias("copies"))


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, each as often as the mix takes it.  Rows equal in
    id, source and text share what the mix takes of them.  No rows: no rows."""
    draw, twin = draws_of(seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), draw.alias("draw"), twin.alias("twin"))
    taken = mix(docs, word_count("text"), seed).groupBy("draw", "twin").agg(F.sum("copies").alias("copies"), F.count("*").alias("equals")).filter("copies > 0")
    both = rows.join(taken, ["draw", "twin"])
    once = both.filter("equals = 1").select("row", F.col("copies").alias("times"))
    place = F.row_number().over(Window.partitionBy("draw", "twin").orderBy("draw"))
    several = both.filter("equals > 1").withColumn("place", place)
    several = several.select("row", (F.floor(F.col("copies") / F.col("equals")) + (F.col("place") <= F.col("copies") % F.col("equals")).cast("int")).alias("times"))
    dealt = once.unionByName(several).filter("times > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("time")).select("row.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count("text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
