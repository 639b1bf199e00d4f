"""Segments from requests: one row per piece of text, keyed by request_id, ordered by pos.

Each source gives (request_id, kind, at, ...) rows; segments() unites them in the fixed order of kinds and numbers
them.  Ids are hashes of request, source and position, so equal builds have equal segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.text import indented, token_count

KINDS = ("system", "few_shot", "tool", "message", "rag", "state", "extra")
COLUMNS = ("request_id", "kind", "at", "type", "role", "content", "priority", "must_keep", "locked", "compressible", "ttl", "namespace", "visibility", "source_id", "score", "rerank_score", "turn")
PRIORITY = {"critical": 1000, "high": 100, "medium": 10, "low": 1}
#: What a type's priority is where none is given.
BY_TYPE = {"system": "critical", "schema": "critical", "user": "high", "tool_definition": "high", "few_shot": "high", "state": "high", "assistant": "medium", "rag": "medium", "tool_call": "medium", "tool_result": "medium", "summary": "medium"}


def _rows(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    base = {"kind": F.lit(kind), "must_keep": F.lit(False), "locked": F.lit(False), "compressible": F.lit(True), "ttl": F.lit(None).cast("int"), "namespace": F.lit("default"), "visibility": F.lit("ALL"), "score": F.lit(None).cast("double"), "rerank_score": F.lit(None).cast("double"), "turn": F.lit(0)} | values
    types = {"at": "long", "turn": "int", "score": "double"}
    return df.select("request_id", *[(base[c].cast(types[c]) if c in types else base[c]).alias(c) for c in COLUMNS[1:]])


def system(df: DataFrame, text: str = "system_prompt") -> DataFrame:
    return _rows(df.filter(F.length(text) > 0), "system", at=F.lit(0), type=F.lit("system"), role=F.lit("system"), content=F.col(text), priority=F.lit("critical"), must_keep=F.lit(True), locked=F.lit(True), compressible=F.lit(False), source_id=F.lit("system_prompt"))


def few_shot(df: DataFrame) -> DataFrame:
    """df: (request_id, at, role, content)."""
    return _rows(df, "few_shot", at=F.col("at"), type=F.lit("few_shot"), role=F.coalesce("role", F.lit("user")), content=F.col("content"), priority=F.lit("high"), locked=F.lit(True), source_id=F.concat(F.lit("few_shot_"), F.col("at").cast("string")))


def tools(df: DataFrame) -> DataFrame:
    """df: (request_id, at, name, content), content the tool's JSON; or (request_id, at, tool), a struct or map, whose name
    is its own and whose JSON is made, indented."""
    if "tool" in df.columns:
        name = F.get_json_object(F.to_json("tool"), "$.name")
        df = df.select("request_id", "at", name.alias("name"), indented(F.to_json("tool")).alias("content"))
    return _rows(df, "tool", at=F.col("at"), type=F.lit("tool_definition"), role=F.lit("system"), content=F.col("content"), priority=F.lit("high"), namespace=F.lit("tools"), source_id=F.concat(F.lit("tool_"), F.coalesce("name", F.col("at").cast("string"))))


def messages(df: DataFrame) -> DataFrame:
    """df: (request_id, at, role, content[, must_keep]); two messages are a turn."""
    keep = F.coalesce("must_keep", F.lit(False)) if "must_keep" in df.columns else F.lit(False)
    return _rows(df, "message", at=F.col("at"), type=F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user"), role=F.col("role"), content=F.col("content"), priority=F.when(keep, "high").otherwise("medium"), must_keep=keep, compressible=~keep, source_id=F.concat(F.lit("message_"), F.col("at").cast("string")), turn=F.floor(F.col("at") / 2))


def rag(df: DataFrame, current_turn: int = 0) -> DataFrame:
    """df: (request_id, at, content, score, source_id)."""
    return _rows(df, "rag", at=F.col("at"), type=F.lit("rag"), role=F.lit("user"), content=F.col("content"), priority=F.lit("medium"), score=F.coalesce("score", F.lit(0.0)), source_id=F.coalesce("source_id", F.concat(F.lit("rag_"), F.col("at").cast("string"))), turn=F.lit(current_turn))


def state(df: DataFrame, prefix: str = "Current state:\n") -> DataFrame:
    """df: (request_id, content), content the state's JSON; or (request_id, state), a struct or map, whose JSON is made,
    indented.  An empty state gives no segment."""
    if "state" in df.columns:
        df = df.select("request_id", indented(F.to_json("state")).alias("content"))
    return _rows(df.filter(F.length("content") > 2), "state", at=F.lit(0), type=F.lit("state"), role=F.lit("system"), content=F.concat(F.lit(prefix), F.col("content")), priority=F.lit("high"), must_keep=F.lit(True), source_id=F.lit("state_anchor"))


def segments(*parts: DataFrame) -> DataFrame:
    """All parts, numbered from 0 in each request, with token counts and ids."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    numbered = union.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy(order, "at")) - 1)
    ident = F.concat(F.lit("seg_"), F.substring(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "source_id", F.col("pos").cast("string")), 256), 1, 12))
    return numbered.withColumn("segment_id", ident).withColumn("token_count", token_count(F.col("content")))


def effective_priority() -> Column:
    by_type = F.create_map(*[F.lit(x) for kv in BY_TYPE.items() for x in kv])
    return F.coalesce("priority", by_type[F.col("type")], F.lit("medium"))


def priority_weight(priority: Column | None = None) -> Column:
    weight = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return weight[priority if priority is not None else effective_priority()]
