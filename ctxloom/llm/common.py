"""What the operators share: tables, the shared working folder, staged tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch: long texts would fill Python's memory with the default of 10,000.
BATCH_ROWS = 2000
#: Bytes of input for which a shuffle has a partition at least.
PART_BYTES = 64 << 20

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, for a query.  Where the session has Spark's own size of Arrow batches, BATCH_ROWS is set."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset on a single machine, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ctxloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/ctxloom-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def partitions(df: DataFrame) -> int:
    """How many partitions df's rows are dealt to: the session's number, or more where the files it reads ask for it."""
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        own = int(str(leaves.next().stats().sizeInBytes()))
        size += own if own < 1 << 60 else 0  # unknown
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // PART_BYTES)))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, and every later job sees one
    version of the rows.  The files go when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As stage(), in buckets of key: joins on key leave these rows in place.  The catalogue has the table's name only
    while it is opened."""
    spark = df.sparkSession
    name = f"ctxloom_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(df), key).format("parquet").option("path", new_path(spark, label)).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return found


@atexit.register
def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before the interpreter
            return


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod) == rest
