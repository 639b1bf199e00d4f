"""Running a stream over what is there now, as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ctxloom.sources.shared import shared_dir


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files, one file or a folder of them, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def run_once(stream: DataFrame, mode: str = "update") -> DataFrame:
    """The rows that the stream gives until it has read all there is; each batch is a Parquet folder of its own, so a
    batch that is run again replaces itself."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/ctxloom-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/*")
