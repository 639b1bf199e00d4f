"""documents to packed training sequences: reject poor texts, keep one of each near-duplicate group, mask personal
data, mix the sources, pack.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the pieces of sequences.
run() writes each stage's rows to the shared folder and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import common, mixing, nearjoin, packing, personal, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go; null and empty texts are among those it rejects or keeps by score."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id, of those the least text hash; rows equal in id and
    text are one document.  Rows without words are linked with nothing and all stay.  Texts move once, to the keys that
    stay; columns may have any name."""
    rows = nearjoin.near_rows(docs)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("ident"), F.col("first.name").alias("name"))
    times = rows.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("ident"), "name").agg(F.count("*").alias("times"))
    kept = kept.join(times, kept["ident"].eqNullSafe(times["ident"]) & (kept["name"] == times["name"]), "left").select(kept["ident"], kept["name"], F.coalesce("times", F.lit(1)).alias("times"))
    kept = common.stage(kept.groupBy("ident", "name").agg(F.max("times").alias("times")), "kept")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_ident"), F.xxhash64("text").alias("own_name"))
    both = held.join(kept, held["own_ident"].eqNullSafe(kept["ident"]) & (held["own_name"] == kept["name"]))
    several = both.filter("times > 1").withColumn("own_text", F.col("row.text")).dropDuplicates(["own_ident", "own_text"])
    return both.filter("times = 1").select("row").unionByName(several.select("row")).select("row.*")


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind's mask; a null text stays null."""
    return personal.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in id, source and text share what it takes of them."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that hold all rows; see packing.pack for nulls, empty texts and repeated rows."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_stage),
    ("personal", personal_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the discriminant; tests/llm compares the stages' rows with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; an empty table gives none."""
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
