"""The final order of a request's segments, merging, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.operators.rerank import REQUEST

#: Fixed types in the order they lead a prompt.
LEADING = ("system", "schema", "tool_definition", "few_shot")


def fixed() -> Column:
    return F.col("locked") | F.col("type").isin(*LEADING)


def order(df: DataFrame) -> DataFrame:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in LEADING]), F.col("type")), F.lit(0)), F.lit(10))
    by = Window.partitionBy(REQUEST).orderBy(F.desc(fixed()), F.when(fixed(), rank).otherwise(0), "pos")
    return df.withColumn("new_pos", (F.row_number().over(by) - 1).cast("int")).drop("pos").withColumnRenamed("new_pos", "pos")


def merge_adjacent(df: DataFrame) -> DataFrame:
    """Runs of one role become a segment, unless the one before is locked."""
    by = Window.partitionBy(REQUEST).orderBy("pos")
    new = F.coalesce((F.lag("role").over(by) != F.col("role")) | F.lag("locked").over(by), F.lit(True))
    island = df.withColumn("island", F.sum(new.cast("int")).over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n")
    return island.groupBy(REQUEST, "island").agg(F.min("pos").alias("pos"), F.min_by("segment_id", "pos").alias("segment_id"), F.min_by("role", "pos").alias("role"), text.alias("content"), F.sum("token_count").alias("token_count"), F.count("*").alias("merged")).drop("island")


def usage(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(REQUEST, by).agg(F.sum("token_count").alias("tokens"), F.count("*").alias("segments"))


def to_messages(df: DataFrame) -> DataFrame:
    """(request_id, messages): role and content in order, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    return df.groupBy(REQUEST).agg(F.to_json(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))
