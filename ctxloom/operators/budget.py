"""Fitting a request's segments to its token budget."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.operators.rerank import REQUEST, score
from ctxloom.sources.ingest import effective_priority, priority_weight


class BudgetError(ValueError):
    """The rigid segments alone exceed the budget and the policy forbids that."""


@dataclass(frozen=True)
class Policy:
    max_context: int = 4096
    output_reserved: int = 512
    thinking_reserved: int = 0
    rigid_types: tuple[str, ...] = ("system", "schema")
    ratios: dict[str, float] = field(default_factory=lambda: {"rag": 0.35, "user": 0.15, "assistant": 0.25})
    min_elastic: int = 256
    saturation: float = 0.9
    overflow: str = "drop"

    @property
    def available(self) -> int:
        return max(0, self.max_context - self.output_reserved - self.thinking_reserved)

    def __post_init__(self):
        if sum(self.ratios.values()) > 1.01:
            raise ValueError("elastic ratios sum to more than 1")


MARK = "...[truncated]"


def rigid(policy: Policy) -> Column:
    return (effective_priority() == "critical") | F.col("type").isin(*policy.rigid_types)


def quota(policy: Policy, kind: Column, available: Column) -> Column:
    """A type's share, at least min_elastic where it has any share; a type without one has 0.  Ratios count as the decimals
    they are written as: 0.35 of 2880 is 1008, which doubles would miss by one."""
    exact = [F.lit(Decimal(repr(r))).cast("decimal(19,18)") for r in policy.ratios.values()]
    ratio = F.coalesce(F.create_map(*[x for k, r in zip(policy.ratios, exact) for x in (F.lit(k), r)])[kind], F.lit(0)) if policy.ratios else F.lit(0)
    share = F.floor(available.cast("decimal(18,0)") * ratio)
    return F.when(ratio > 0, F.greatest(share, F.lit(policy.min_elastic))).otherwise(share).cast("long")


def _quotas(policy: Policy) -> dict[str, int]:
    """quota() of each type that has a ratio, where everything is available."""
    return {k: max(int(policy.available * Decimal(repr(r))), policy.min_elastic) if r > 0 else 0 for k, r in policy.ratios.items()}


def split_rigid(df: DataFrame, policy: Policy) -> DataFrame:
    """df with rigid, rigid_used and elastic (what is left for the others)."""
    used = F.coalesce(F.sum(F.when(rigid(policy), F.col("token_count"))).over(Window.partitionBy(REQUEST)), F.lit(0))
    return df.withColumn("rigid", rigid(policy)).withColumn("rigid_used", used.cast("long")).withColumn("elastic", F.greatest(F.lit(0), F.lit(policy.available) - F.col("rigid_used")).cast("long"))


RANK = ("weight", "relevance")


def _slim(df: DataFrame) -> DataFrame:
    """What the decisions need of df's rows: no texts."""
    return df.select(REQUEST, "pos", "type", "token_count", "compressible", "rigid", "rigid_used", "elastic", priority_weight().alias("weight"), score().alias("relevance"))


def _folded(df: DataFrame, order: list[Column], schema: str, fold) -> DataFrame:
    """Streams the rows of each request in order through fold, a generator over Arrow batches: a task holds one request's
    state, not its rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, REQUEST).sortWithinPartitions(REQUEST, *order).mapInArrow(fold, schema)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _by_rank() -> list[Column]:
    return [F.desc("weight"), F.desc("relevance"), F.asc("pos")]


def _first_phase(slim: DataFrame, policy: Policy) -> DataFrame:
    """slim with decision and tokens: per type by priority and score what fits its quota is kept; what doesn't is cut to
    the rest if that is at least min_elastic and it may shrink; else dropped."""
    rows = slim.withColumn("quota", quota(policy, F.col("type"), F.col("elastic")))
    least = policy.min_elastic
    at = {name: i for i, name in enumerate(rows.columns)}

    def fold(batches):
        key, left = None, 0
        for batch in batches:
            decisions, spent = [], []
            for request, kind, need, shrinks, rigid_, most in zip(*(batch.column(at[c]).to_pylist() for c in (REQUEST, "type", "token_count", "compressible", "rigid", "quota"))):
                if (request, kind) != key:
                    key, left = (request, kind), most
                if rigid_:
                    decision, tokens = "rigid", need
                elif need <= left:
                    decision, tokens = "keep", need
                elif left >= least and shrinks:
                    decision, tokens = "truncate", left
                else:
                    decision, tokens = "drop", 0
                left -= 0 if rigid_ else tokens
                decisions.append(decision)
                spent.append(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decisions, pa.string()), pa.array(spent, pa.int64())], names=[*batch.schema.names, "decision", "tokens"])

    return _folded(rows, [F.asc("type"), *_by_rank()], _schema(rows, "decision string", "tokens long"), fold)


def _second_phase(decided: DataFrame) -> DataFrame:
    """decided with dropped rows taken back (rescue) by priority and score while they fit what the request has left."""
    used = F.sum(F.when(F.col("rigid"), 0).otherwise(F.col("tokens"))).over(Window.partitionBy(REQUEST))
    rows = decided.withColumn("room", F.greatest(F.lit(0), F.col("elastic") - used).cast("long"))
    at = {name: i for i, name in enumerate(rows.columns)}

    def fold(batches):
        key, left = None, 0
        for batch in batches:
            decisions, spent = [], []
            for request, need, decision, tokens, room in zip(*(batch.column(at[c]).to_pylist() for c in (REQUEST, "token_count", "decision", "tokens", "room"))):
                if request != key:
                    key, left = request, room
                if decision == "drop" and need <= left:
                    decision, tokens, left = "rescue", need, left - need
                decisions.append(decision)
                spent.append(tokens)
            columns = dict(zip(batch.schema.names, batch.columns)) | {"decision": pa.array(decisions, pa.string()), "tokens": pa.array(spent, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _folded(rows, _by_rank(), _schema(rows), fold)


def elastic(df: DataFrame, policy: Policy) -> DataFrame:
    """(request_id, pos, decision, tokens) of the segments of split_rigid() that aren't rigid, by the first phase alone."""
    return _first_phase(_slim(df).filter(~F.col("rigid")), policy).select(REQUEST, "pos", "decision", "tokens")


def rescue(df: DataFrame, policy: Policy) -> DataFrame:
    """(request_id, pos, decision, tokens) of the segments of split_rigid() that aren't rigid, by both phases."""
    return _second_phase(_first_phase(_slim(df).filter(~F.col("rigid")), policy)).select(REQUEST, "pos", "decision", "tokens")


def truncated(text: Column, tokens: Column, target: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), F.floor(F.length(text) * target / tokens).cast("int")), F.lit(MARK))


def allocate(df: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(kept segments in their new order, decisions).  Rigid ones first in order, then kept ones by their type's first
    place and rank, then rescued ones.  Decisions and places are found on rows without texts; texts move once, to be
    joined with them.  Rigid segments over the budget are all kept, unless the policy's overflow is "error"."""
    marked = split_rigid(df.select(REQUEST, "pos", "segment_id", "type", "priority", "token_count", "compressible", "score", "rerank_score"), policy)
    if policy.overflow == "error" and marked.filter(F.col("rigid_used") > policy.available).limit(1).count():
        raise BudgetError("rigid segments exceed the budget")
    first = F.min("pos").over(Window.partitionBy(REQUEST, "type"))
    slim = marked.select(*_slim(marked).columns[:8], priority_weight().alias("weight"), score().alias("relevance"), "segment_id", first.alias("type_first"))
    decided = _second_phase(_first_phase(slim, policy))
    group = F.when(F.col("decision") == "rigid", 0).when(F.col("decision") == "rescue", 2).when(F.col("decision") == "drop", 3).otherwise(1)
    by = Window.partitionBy(REQUEST).orderBy(group, F.when(group == 1, F.col("type_first")).otherwise(0), F.when(group == 0, F.col("pos")).otherwise(0), F.desc("weight"), F.desc("relevance"), "pos")
    placed = decided.select(REQUEST, F.col("pos").alias("__from"), "decision", F.col("tokens").alias("__tokens"), (F.row_number().over(by) - 1).cast("int").alias("__to")).filter("decision <> 'drop'")
    joined = df.join(placed.withColumnRenamed(REQUEST, "__request"), (df[REQUEST] == F.col("__request")) & (df["pos"] == F.col("__from")))
    cut = F.col("decision") == "truncate"
    kept = joined.withColumn("content", F.when(cut, truncated(F.col("content"), F.col("token_count"), F.col("__tokens"))).otherwise(F.col("content"))).withColumn("token_count", F.when(cut, F.col("__tokens")).otherwise(F.col("token_count")).cast("int"))
    return kept.select(*[c for c in df.columns if c != "pos"], F.col("__to").alias("pos")), decided.select(REQUEST, "segment_id", "type", "decision", "tokens")


def allocation(decisions: DataFrame, policy: Policy) -> DataFrame:
    """One row per request and type with what it uses, beside the request's totals and whether it is saturated."""
    used = F.when(F.col("decision") == "drop", 0).otherwise(F.col("tokens"))
    per_type = decisions.groupBy(REQUEST, "type").agg(F.sum(used).alias("used"), F.sum(F.when(F.col("decision") == "drop", 1).otherwise(0)).alias("dropped"), F.sum(F.when(F.col("decision") == "rigid", F.col("tokens")).otherwise(0)).alias("rigid_used"))
    total = F.sum("used").over(Window.partitionBy(REQUEST))
    rate = F.col("total_used") / policy.available if policy.available else F.lit(0.0)
    return per_type.withColumn("total_used", total).withColumns({"saturation": rate, "saturated": rate > policy.saturation, "over": F.col("total_used") > policy.available})


def invalid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("token_count").isNull() | (F.col("token_count") < 0))


def bids(df: DataFrame, policy: Policy, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.3) -> DataFrame:
    """df with bid: priority, relevance and the type's share of all quotas, weighed."""
    own = quota(policy, F.col("type"), F.lit(policy.available))
    total = sum(_quotas(policy).values())
    share = own / total if total else F.lit(0.0)
    return df.withColumn("bid", priority_weight() * alpha + score() * beta + share * gamma)


def greedy(df: DataFrame, policy: Policy) -> DataFrame:
    """(request_id, pos, kept): in bid order a segment is kept if it fits the request's rest and its type's; a type
    without a quota has the request's."""
    rows = bids(df, policy).select(REQUEST, "pos", "type", "token_count", "bid")
    quotas = _quotas(policy)
    available = policy.available

    def fold(batches):
        key, left, own = None, 0, {}
        for batch in batches:
            kept = []
            for request, kind, need in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if request != key:
                    key, left, own = request, available, dict(quotas)
                fits = left > 0 and need <= left and need <= own.get(kind, left)
                if fits:
                    left -= need
                    if kind in own:
                        own[kind] -= need
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.bool_())], names=[REQUEST, "pos", "kept"])

    return _folded(rows, [F.desc("bid"), F.asc("pos")], _schema(rows.select(REQUEST, "pos"), "kept boolean"), fold)
