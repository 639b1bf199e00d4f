"""Document fingerprints (SimHash).

A text's terms are its pairs of consecutive words (a lone word stands for itself).  Each occurrence of a term votes on
64 signed bits with the term's hash; its weight is the term's length in bytes, at most 24, because longer terms are
rarer.  A bit is set if its votes sum to more than 0.  Null, empty and wordless texts have the fingerprint 0.

near_pairs() and near_counts() find all fingerprints within a Hamming radius r by permuted block tables: 64 bits are cut
in r + 3 blocks, two fingerprints within r agree in 3 whole blocks at least, so one table for each choice of 3 blocks,
keyed by those blocks, brings every such pair together.  Equal fingerprints are one class, never expanded into pairs.
Tables travel as packed arrays; a key's fingerprints are compared within a task, in tiles of TILE by TILE where there are
more, so that counting makes no row for a pair.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import partitions, stage, table
from ctxloom.llm.wordhash import gram_hashes, mix, slices, text_buffer, word_bounds, word_hashes

BITS = 64
#: A term's greatest weight.
MOST = 24
#: Terms whose bits are unpacked at a time.
STEP = 1 << 14
#: The query's Hamming radius.
RADIUS = 3
#: Fingerprints of one key compared at a time, and those a task gathers before it deals them.
TILE, GATHER = 2048, 1 << 18
#: Bytes of text for which a document counts once more where ranges are cut.
WEIGH = 4096


def simhash(column: pa.Array) -> np.ndarray:
    """uint64 fingerprint of each text."""
    data, offsets = text_buffer(column)
    return np.concatenate([_simhash(data, offsets[i : j + 1]) for i, j in slices(offsets)] or [np.zeros(0, np.uint64)])


def _simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    single = gram_hashes(words, 1)
    terms, length = single.copy(), (ends - starts).copy()
    if len(words) > 1:
        pairs = gram_hashes(words, 2)
        terms[:-1], length[:-1] = pairs, length[:-1] + length[1:]
    counts = np.diff(first)
    keep = np.ones(len(words), dtype=bool)
    last = first[1:][counts > 1] - 1
    keep[last] = False
    lone = first[:-1][counts == 1]
    terms[lone], length[lone] = single[lone], (ends - starts)[lone]
    weights = np.minimum(length, MOST).astype(np.float32)
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    terms, weights = terms[keep], weights[keep]
    votes = np.zeros((len(counts), BITS), np.float64)
    for i in range(0, len(terms), STEP):
        part, own = weights[i : i + STEP, None], owner[i : i + STEP]
        bits = np.unpackbits(terms[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[edge]] += np.add.reduceat(bits * part, edge, axis=0)
        votes[own[edge]] -= np.add.reduceat(part, edge, axis=0) / 2
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """docs with one more column (long), which it must not have yet; its other columns pass through."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash(pa.array(texts, pa.large_string(), from_pandas=True)).view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def block_masks(radius: int) -> np.ndarray:
    """The bits that key each table."""
    if not 1 <= radius <= 7:
        raise ValueError("radius must lie between 1 and 7")
    n = radius + 3
    edges = [BITS * i // n for i in range(n + 1)]
    return np.array([sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(n), 3)], np.uint64)


def close(a: np.ndarray, b: np.ndarray, table: int, masks: np.ndarray, radius: int) -> np.ndarray:
    """Places of the pairs within radius whose first common table is this one."""
    differ = a ^ b
    at = np.flatnonzero(np.bitwise_count(differ) <= radius)
    for mask in masks[:table]:
        at = at[(differ[at] & mask) != 0]
    return at


def pairs_of(prints: np.ndarray, table: int, masks: np.ndarray, radius: int):
    """Pairs (a, b) of one table that share a key, in parts; of a key with over TILE fingerprints none, but its
    fingerprints: (None, prints)."""
    key = prints & masks[table]
    order = np.argsort(key, kind="stable")
    key, prints = key[order], prints[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    for i in np.flatnonzero(size > TILE):
        yield None, prints[edge[i] : edge[i + 1]]
    rest = np.repeat(np.where(size > TILE, 0, size) - 1, size) - (np.arange(len(key)) - np.repeat(edge[:-1], size))
    first = np.flatnonzero(rest > 0)
    for step in range(1, TILE):
        first = first[rest[first] >= step]
        if not len(first):
            return
        found = close(prints[first], prints[first + step], table, masks, radius)
        yield prints[first[found]], prints[first[found] + step]


def _near(texts_or_prints: DataFrame, radius: int, pairs: bool) -> DataFrame:
    """Of a column of fingerprints (long) or texts: (a, b) of each pair, or (a, b: how many) of each fingerprint and part."""
    masks, parts = block_masks(radius), partitions(texts_or_prints)
    texts = texts_or_prints.schema[0].dataType.simpleString() == "string"

    def deal(batches):
        def rows(prints):
            for table, mask in enumerate(masks):
                part = (mix(prints & mask) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                own = np.flatnonzero(np.diff(edge))
                held = prints[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), table, np.int32)), pa.array(own.astype(np.int32)), pa.array([held[edge[i] : edge[i + 1]].tobytes() for i in own], pa.binary())], names=["at", "part", "prints"])

        held, size = [], 0
        for batch in batches:
            column = batch.column(0)
            held.append(simhash(column) if texts else np.asarray(column.drop_null()).view(np.uint64))
            size += len(held[-1])
            if size >= GATHER:
                yield from rows(np.unique(np.concatenate(held)))
                held, size = [], 0
        if size:
            yield from rows(np.unique(np.concatenate(held)))

    names = ["a", "b", "at", "x", "y"]

    def out(found):
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = (np.minimum(a, b), np.maximum(a, b)) if pairs else np.unique(np.r_[a, b], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), *[pa.nulls(len(a), pa.binary())] * 2], names=names)

    def tiles_of(table, tiles):
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(tiles), pa.int64())] * 2, pa.array([table] * len(tiles), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*tiles))], names=names)

    def meet(batches):
        def rows(table, held):
            found = []
            for a, b in pairs_of(np.unique(np.concatenate([np.frombuffer(h, np.uint64) for h in held])), table, masks, radius):
                if a is not None:
                    found.append((a, b))
                    continue
                chunks = [b[i : i + TILE].tobytes() for i in range(0, len(b), TILE)]
                for i, x in enumerate(chunks):
                    yield tiles_of(table, [(x, y) for y in chunks[i:]])
            yield out(found)

        group, held = None, []
        for batch in batches:
            for table, part, prints in zip(*(c.to_pylist() for c in batch.columns)):
                if (table, part) != group and held:
                    yield from rows(group[0], held)
                    held = []
                group = table, part
                held.append(prints)
        if held:
            yield from rows(group[0], held)

    def tile(batches):
        for batch in batches:
            for table, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                found = []
                for i, value in enumerate(x):
                    other = x[i + 1 :] if left == right else y
                    at = close(np.full(len(other), value), other, table, masks, radius)
                    found.append((np.full(len(at), value), other[at]))
                yield out(found).select(["a", "b"])

    dealt = texts_or_prints.mapInArrow(deal, "at int, part int, prints binary")
    met = stage(dealt.repartition(parts, "at", "part").sortWithinPartitions("at", "part").mapInArrow(meet, "a long, b long, at int, x binary, y binary"), "near")
    tiles = met.filter("x is not null").select("at", "x", "y").repartition(parts, F.xxhash64("at", "x", "y")).mapInArrow(tile, "a long, b long")
    return met.filter("x is null").select("a", "b").unionByName(tiles)


def near_pairs(prints: DataFrame, radius: int, fingerprint: str = "simhash") -> DataFrame:
    """(a, b, distance), a < b: all pairs of different fingerprints within radius.  Each pair comes once, from the first
    table that brings it together.  Rows that share a fingerprint are one member; join back on it for the rows.  Null
    fingerprints have no pairs; no rows: no rows."""
    found = _near(prints.select(F.col(fingerprint).cast("long")), radius, True)
    return found.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance"))


def near_counts(docs: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(fingerprint, near): how many other fingerprints of docs lie within radius, where any does."""
    return _near(docs.select(F.col(text).cast("string")), radius, False).groupBy(F.col("a").alias("fingerprint")).agg(F.sum("b").alias("near"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text: the last floor(n/2) code points give way to the
    first as many (or all) of the next document in descending doc_id; the last one's next is the first.

    Equal ids follow one another by the descending hash of their texts, then the texts; a null id comes last.  Texts are
    shuffled once: to ranges of ids, cut so that each has its share of rows and bytes (an id with more than a range's
    share is cut by the hash), each with a copy of the row that follows it in the next range (one row per range, or its
    equals).  No text, or an empty one: n_chars 0, the fingerprint 0.  A long text is taken whole.  No rows: no rows.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = partitions(docs)
    weight = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WEIGH)).cast("int")
    slim = stage(rows.select("at", "hash", weight.alias("weight")), "places")
    found = slim.select("at", F.explode(F.sequence(F.lit(1), "weight"))).agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    ids, times = np.unique(np.array(found, np.int64), return_counts=True)
    cut_at = np.repeat(ids, times)
    cut_hash = np.array([-(1 << 63) + (i << 64) // k for k in times.tolist() for i in range(k)], np.int64)

    def place(at: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(cut_at, at), np.searchsorted(cut_at, at, side="right")
        for i in np.unique(at[high > low]):
            own, k = np.flatnonzero(at == i), np.searchsorted(cut_at, i)
            low[own] = k + np.searchsorted(cut_hash[cut_at == i], hashed[own], side="right")
        return low

    @F.pandas_udf("int")
    def range_of(at: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(place(at.to_numpy(np.int64), hashed.to_numpy(np.int64)))

    tops = slim.withColumn("part", range_of("at", "hash")).groupBy("part").agg(F.max(F.struct("at", "hash")).alias("top")).collect()
    tops = sorted((r["part"], r["top"]["at"], r["top"]["hash"]) for r in tops)
    # A range's greatest row follows the range above it.
    goes_to = {(at, hashed): tops[(i + 1) % len(tops)][0] for i, (_, at, hashed) in enumerate(tops)}
    top_ids = np.array(sorted({at for at, _ in goes_to}), np.int64)

    @F.pandas_udf("array<int>")
    def parts_of(at: pd.Series, hashed: pd.Series) -> pd.Series:
        at, hashed = at.to_numpy(np.int64), hashed.to_numpy(np.int64)
        out = [[x] for x in (2 * place(at, hashed)).tolist()]
        for i in np.flatnonzero(np.isin(at, top_ids)):
            if (target := goes_to.get((int(at[i]), int(hashed[i])))) is not None:
                out[i].append(2 * target + 1)
        return pd.Series(out)

    dealt = rows.select("at", "hash", "doc_id", "text", F.explode(parts_of("at", "hash")).alias("code")).select("at", "hash", "doc_id", "text", (F.col("code") / 2).cast("int").alias("part"), (F.col("code") % 2).alias("after"))
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "after", F.desc("at"), F.desc("hash"), "text").select("part", "after", "doc_id", "text")

    def edit(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)))
            ids, texts, edited, sizes = [], [], [], []
            for (part, after, doc_id, text), (other, _, _, following) in zip(held, held[1:]):
                if after or part != other:
                    texts.append(text)
                    ids.append(None)
                    edited.append(None)
                    continue
                half = len(text) // 2
                ids.append((doc_id,))
                texts.append(text)
                edited.append(text[: len(text) - half] + following[:half])
            prints = simhash(pa.array([*texts, held[-1][3]], pa.large_string())) if held else np.zeros(0, np.uint64)
            held = held[-1:]
            keep = [i for i, x in enumerate(ids) if x is not None]
            if not keep:
                continue
            new = simhash(pa.array([edited[i] for i in keep], pa.large_string()))
            own = prints[keep]
            following = prints[np.array(keep) + 1]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[i][0] for i in keep], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in keep], pa.int64()),
                "edited_sha256": [hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest() for i in keep],
                "fingerprint": [f"{x:016x}" for x in own.tolist()],
                "edited_fingerprint": [f"{x:016x}" for x in new.tolist()],
                "near_edited": likeness(own, new),
                "near_next": likeness(own, following),
            })

    return ordered.mapInArrow(edit, EDITED)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: how many other fingerprints of the table lie within RADIUS of the document's."""
    docs = table(spark, sf_dir, "documents")
    near = near_counts(docs).select(F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("near").alias("n_near"))
    return edited_fingerprints(docs).join(near, "fingerprint", "left").select(*[x.split()[0] for x in EDITED.split(", ")], F.coalesce("n_near", F.lit(0)).alias("n_near"))
