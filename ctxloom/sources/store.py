"""Snapshots of built requests as Parquet, and input files."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_requests(spark: SparkSession, path: str) -> dict | list:
    """A JSON or YAML file by its suffix; of another suffix JSON, then YAML.  A YAML root is a mapping."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if not path.endswith((".yaml", ".yml")):
        try:
            return json.loads(text)
        except ValueError:
            if path.endswith(".json"):
                raise
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is expected at the root")
    return found


def merged(base: dict, more: dict) -> dict:
    """base with more laid over it, mapping by mapping."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def save(segments: DataFrame, path: str, model: str, at: str, tags: dict[str, str] | None = None) -> None:
    """Appends requests as snapshots, a partition per model; a snapshot's id is its time and its request."""
    tag = F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]) if tags else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ident = F.concat(F.lit(f"snap_{at}_"), F.substring(F.col("request_id").cast("string"), 1, 8))
    segments.withColumn("snapshot_id", ident).withColumn("taken", F.lit(at)).withColumn("tags", tag).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)


class SnapshotMissing(KeyError):
    """There is no snapshot of an id."""


def _deleted(path: str) -> str:
    return path.rstrip("/") + ".deleted"


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots but the deleted ones, whose ids are a table beside them."""
    rows = spark.read.parquet(path)
    try:
        gone = spark.read.schema("snapshot_id string").parquet(_deleted(path))
    except AnalysisException:
        return rows
    return rows.join(gone.distinct(), "snapshot_id", "left_anti")


def load(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    rows = _live(spark, path).filter(F.col("snapshot_id") == snapshot_id)
    if not rows.limit(1).count():
        raise SnapshotMissing(snapshot_id)
    return rows


def search(spark: SparkSession, path: str, tags: dict[str, str] | None = None, model: str | None = None, most: int | None = 100) -> DataFrame:
    """The latest snapshots that carry all tags, one row each."""
    rows = _live(spark, path)
    rows = rows.filter(F.col("model") == model) if model else rows
    for k, v in (tags or {}).items():
        rows = rows.filter(F.col("tags")[k] == v)
    found = rows.groupBy("snapshot_id", "taken", "model").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("segments"))
    return found.orderBy(F.desc("snapshot_id")).limit(most) if most is not None else found


def list_all(spark: SparkSession, path: str) -> DataFrame:
    return search(spark, path, most=None)


def delete(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """Whether there was such a snapshot; its rows go when the store is compacted."""
    rows = _live(spark, path).filter(F.col("snapshot_id") == snapshot_id).select("snapshot_id").limit(1)
    if not rows.count():
        return False
    rows.write.mode("append").parquet(_deleted(path))
    return True


def clean_up(spark: SparkSession, path: str, before: str) -> None:
    """Deletes snapshots taken before a time."""
    old = _live(spark, path).filter(F.col("taken") < before).select("snapshot_id").distinct()
    old.write.mode("append").parquet(_deleted(path))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes what is live to a new place; switch readers over to it."""
    _live(spark, path).write.partitionBy("model").parquet(to)


def newer(spark: SparkSession, path: str, since: str) -> DataFrame:
    return _live(spark, path).filter(F.col("taken") >= since)
