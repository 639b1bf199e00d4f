"""The tables' rows as segments, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.operators.budget import Policy
from ctxloom.sources import ingest

POLICY = Policy()
VISIBILITIES = ("ALL", "CURRENT_TURN", "AGENT_ONLY", "INTERNAL", "NAMESPACE", "DOWNSTREAM", "GLOBAL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to conversations by a hash of their text, so that equal texts meet."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")))
    n = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n")).scalar()
    request = F.conv(F.substring(F.md5(F.col("content").cast("binary")), 1, 6), 16, 10).cast("long") % n
    score = ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)
    return docs.select(request.alias("request_id"), F.col("doc_id").alias("at"), "content", score.alias("score"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_id"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.segments(ingest.messages(messages(spark, sf_dir)), ingest.rag(passages(spark, sf_dir)))


def flagged(df: DataFrame) -> DataFrame:
    """segments with flags by place, so that every branch occurs."""
    pos = F.col("pos")
    return df.withColumns({
        "ttl": F.when(pos % 5 == 0, pos % 7).cast("int"),
        "turn": (pos % 6).cast("int"),
        "visibility": F.element_at(F.array(*[F.lit(v) for v in VISIBILITIES]), (pos % 7 + 1).cast("int")),
        "namespace": F.when(pos % 3 == 0, "default").when(pos % 3 == 1, "tools").otherwise("research"),
        "locked": pos % 11 == 0,
        "must_keep": pos % 9 == 0,
        "compressible": pos % 13 != 0,
        "priority": F.when(pos % 17 == 0, "critical").when(pos % 4 == 1, "high").when(pos % 4 == 2, "low").otherwise("medium"),
    })


TOKENS = "CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(content) / (4.0 - (length(content) - length(regexp_replace(content, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2CEAF}\\x{2CEB0}-\\x{2EBEF}\\x{30000}-\\x{3134F}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g'))) / length(content) * 2.5)) AS INTEGER)) END"
SEGMENTS = f"""
 n AS (SELECT max(conv_id) + 1 AS k FROM conversations),
 raw AS (
  SELECT conv_id AS request_id, 4 AS kind, turn AS "at", CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS type, role,
         text AS content, 'message_' || turn AS source_id, CAST(NULL AS DOUBLE) AS score, CAST(floor(turn / 2) AS INTEGER) AS turn FROM conversations
  UNION ALL
  SELECT CAST(concat('0x', substr(md5(coalesce(text, '')), 1, 6)) AS BIGINT) % k, 5, doc_id, 'rag', 'user', coalesce(text, ''), 'doc_' || doc_id, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000.0, 0
  FROM documents, n),
 numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY kind, "at") - 1 AS INTEGER) AS pos FROM raw),
 seg AS (SELECT *, CAST(NULL AS DOUBLE) AS rerank_score, 'medium' AS priority, FALSE AS locked, FALSE AS must_keep, TRUE AS compressible,
         {TOKENS} AS token_count, 'seg_' || substr(sha256(request_id || '|' || source_id || '|' || pos), 1, 12) AS segment_id FROM numbered)"""
FLAGGED = (
    SEGMENTS
    + """,
 fl AS (SELECT request_id, pos, type, role, content, source_id, score, rerank_score, token_count, segment_id,
  CASE WHEN pos % 5 = 0 THEN pos % 7 END AS ttl, pos % 6 AS turn,
  ['ALL', 'CURRENT_TURN', 'AGENT_ONLY', 'INTERNAL', 'NAMESPACE', 'DOWNSTREAM', 'GLOBAL'][pos % 7 + 1] AS visibility,
  CASE pos % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'tools' ELSE 'research' END AS namespace,
  pos % 11 = 0 AS locked, pos % 9 = 0 AS must_keep, pos % 13 <> 0 AS compressible,
  CASE WHEN pos % 17 = 0 THEN 'critical' WHEN pos % 4 = 1 THEN 'high' WHEN pos % 4 = 2 THEN 'low' ELSE 'medium' END AS priority FROM seg),
 fw AS (SELECT *, CASE priority WHEN 'critical' THEN 1000 WHEN 'high' THEN 100 WHEN 'medium' THEN 10 ELSE 1 END AS weight,
  coalesce(nullif(rerank_score, 0), nullif(score, 0), 0.0) AS s FROM fl)"""
)
