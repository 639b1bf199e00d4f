"""Exact nearest neighbours by inner product as a block matrix join.

Vectors are kept in blocks with int8 codes, a scale each and the norm of what rounding left over.  A tile is the
product of a block of queries and a block of candidates: integer products of the codes, exact in float, give the inner
product up to |q||c - c'| + |q - q'||c'| (Cauchy-Schwarz).  A candidate whose upper bound lies below the k-th lower
bound of its query can't be among the k nearest; the rest are recomputed from the original vectors in double precision
and go to a heap of k per query.  Queries are dealt in slabs of SLAB, candidates in shares of about SHARE; a task holds one slab and streams
a share's blocks past it, so its memory doesn't grow with either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.llm.common import stage, table

K = 20
BLOCK, SLAB, SHARE = 1024, 4096, 8192


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (as float32 for the product), scales, norms, norms of the residue."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    residue = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, np.linalg.norm(x, axis=1), residue


def tile(q, c) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products and their error bounds for two blocks of (codes, scale, norm, residue)."""
    kind = np.float32 if q[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = q[0].astype(kind) @ c[0].astype(kind).T
    rough = product * q[1][:, None] * c[1][None, :]
    slack = q[2][:, None] * c[3][None, :] + q[3][:, None] * (c[2] + c[3])[None, :]
    return rough, slack + 1e-9 * q[2][:, None] * c[2][None, :]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, c)


class Heaps:
    """The k nearest of each query so far: by score, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.uids, self.x, self.k = ids, uids, x, k
        self.parts = quantise(x)
        self.score = np.full((len(x), k), -np.inf)
        self.found = np.full((len(x), k), np.iinfo(np.int64).max, np.int64)

    def block(self, ids: np.ndarray, uids: np.ndarray, x: np.ndarray) -> None:
        rough, slack = tile(self.parts, quantise(x))
        rough[self.uids[:, None] == uids[None, :]] = -np.inf
        low = rough - slack
        floor = self.score[:, -1]
        if len(ids) >= self.k:
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        rows, columns = np.nonzero((rough + slack >= floor[:, None]) & np.isfinite(rough))
        if not len(rows):
            return
        exact = scores(self.x[rows], x[columns])
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
            i = rows[at[0]]
            score, found = np.r_[self.score[i], exact[at]], np.r_[self.found[i], ids[columns[at]]]
            best = np.lexsort((found, -score))[: self.k]
            self.score[i], self.found[i] = score[best], found[best]


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, uid, x): rows with an id whose vectors aren't null, empty or zero and hold no null or non-finite number."""
    x = F.col("x")
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("id is not null and x is not null")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(whole & F.exists(x, lambda v: v != 0)).withColumn("uid", F.monotonically_increasing_id())


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten()).reshape(len(values), -1).astype(np.float64)


def nearest(vectors: DataFrame, is_query, k: int = K, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest inner product for each row for which is_query holds.

    A query's own row is left out; another row with its id or its vector is not.  Vectors of another length than a
    query's aren't compared with it.  Fewer than k candidates: all of them.  No usable vectors: no rows."""
    rows = stage(usable(vectors, ident, vector).withColumn("dims", F.size("x")), "vectors")
    asked = rows.filter(is_query(F.col("id")))
    slabs = {r["dims"]: max(1, -(-r["n"] // SLAB)) for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    if not slabs:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = F.element_at(F.create_map(*[F.lit(v) for kv in slabs.items() for v in kv]), F.col("dims"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def columns(kind: int):
        return ["dims", "slab", F.lit(kind).alias("kind"), "id", "uid", "x"]

    queries = asked.withColumn("slab", F.pmod(F.xxhash64("uid"), count).cast("int"))
    candidates = rows.filter(F.col("dims").isin(list(slabs))).withColumn("slab", F.explode(F.sequence(F.lit(0), count - 1)))
    # Each slab meets every candidate in `split` groups; a group holds the slab's queries and a share of the candidates.
    split = max(1, -(-rows.count() // SHARE))
    queries = queries.select(*columns(0), F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("share"))
    candidates = candidates.select(*columns(1), F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(split)).cast("int").alias("share"))
    dealt = queries.unionByName(candidates).repartition(parts, "dims", "slab", "share").sortWithinPartitions("dims", "slab", "share", "kind")

    def search(batches):
        schema = pa.schema([("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        group, held, heaps = None, [], None

        def finish():
            if heaps is not None:
                keep = np.isfinite(heaps.score)
                n = keep.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(heaps.ids, n)), pa.array(np.repeat(heaps.uids, n)), pa.array(heaps.found[keep]), pa.array(heaps.score[keep])], schema=schema)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in (0, 1, 6)], axis=1)
            kind = np.asarray(batch.column(2))
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(kind)]):
                if low == high:
                    continue
                if group != tuple(keys[low]):
                    yield from finish()
                    group, held, heaps = tuple(keys[low]), [], None
                part = batch.slice(low, high - low)
                block = np.asarray(part.column(3)), np.asarray(part.column(4)), _matrix(part.column(5))
                if kind[low] == 0:
                    held.append(block)
                elif held or heaps is not None:
                    if heaps is None:
                        heaps, held = Heaps(*(np.concatenate(c) for c in zip(*held)), k), []
                    for i in range(0, high - low, BLOCK):
                        heaps.block(*(c[i : i + BLOCK] for c in block))
        yield from finish()

    found = dealt.mapInArrow(search, "query_id long, uid long, vec_id long, score double")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
