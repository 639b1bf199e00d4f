"""Shrinking segments when a request is over its budget."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.grams import gram_sets, mix
from ctxloom.operators.rerank import REQUEST
from ctxloom.sources.ingest import effective_priority, priority_weight
from ctxloom.sources.shared import written


def saturation(df: DataFrame, available: int) -> DataFrame:
    return df.groupBy(REQUEST).agg(F.sum("token_count").alias("tokens")).withColumn("saturation", F.col("tokens") / available if available > 0 else F.lit(0.0))


class CompressionError(ValueError):
    """Nothing that may be shrunk is left, and a request is still over its budget."""


def eligible(least: int = 0, keep_must: bool = True) -> Column:
    size = F.coalesce("token_count", F.lit(0))
    out = (effective_priority() != "critical") & F.col("compressible") & ((size == 0) | (size >= least))
    return out & ~F.col("must_keep") if keep_must else out


def _cut(df: DataFrame, target: Column, tail: bool, active: Column | None = None) -> DataFrame:
    """The head (or tail) of each request up to target tokens; the segment at the boundary is cut to the rest.  Rows that
    aren't active stay as they are and don't count."""
    df = df.withColumn("active", F.lit(True) if active is None else F.coalesce(active, F.lit(False))).withColumn("goal", target)
    along = Window.partitionBy(REQUEST, "active").orderBy(F.desc("pos") if tail else F.asc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("upto", F.sum("token_count").over(along)).withColumn("rest", F.col("goal") - (F.col("upto") - F.col("token_count")))
    size = F.floor(F.length("content") * F.col("rest") / F.col("token_count")).cast("int")
    part = F.right(F.col("content"), size) if tail else F.substring("content", F.lit(1), size)
    fits = F.col("upto") <= F.col("goal")
    out = out.filter(~F.col("active") | fits | (F.col("rest") > 0)).withColumn("cut", F.col("active") & ~fits)
    out = out.withColumn("content", F.when(F.col("cut"), part).otherwise(F.col("content"))).withColumn("token_count", F.when(F.col("cut"), F.col("rest")).otherwise(F.col("token_count")).cast("int"))
    return out.filter(~F.col("cut") | (F.length("content") > 0)).drop("upto", "rest", "active", "goal")


def keep_head(df: DataFrame, target: int) -> DataFrame:
    return _cut(df, F.lit(target), False)


def keep_tail(df: DataFrame, target: int) -> DataFrame:
    return _cut(df, F.lit(target), True)


def keep_ends(df: DataFrame, target: int, head: float = 0.5) -> DataFrame:
    """Head and tail of requests over target; requests within it stay whole.  A segment cut by both comes twice."""
    total = F.sum("token_count").over(Window.partitionBy(REQUEST))
    first = int(target * head)
    over = df.withColumn("total", total)
    whole = over.filter(F.col("total") <= target).drop("total").withColumn("cut", F.lit(False)).withColumn("part", F.lit("whole"))
    long = over.filter(F.col("total") > target).drop("total")
    return whole.unionByName(keep_head(long, first).withColumn("part", F.lit("head"))).unionByName(keep_tail(long, target - first).withColumn("part", F.lit("tail")))


def ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(after / before)


def saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), before - after)


def split_turns(df: DataFrame, recent: int = 2) -> DataFrame:
    """df with recent: whether a row is of the last turns; rows without a turn are older; where none has one the last
    two rows a turn are recent."""
    by_turn = F.dense_rank().over(Window.partitionBy(REQUEST).orderBy(F.col("turn").desc_nulls_last()))
    by_place = F.row_number().over(Window.partitionBy(REQUEST).orderBy(F.desc("pos")))
    known = F.count("turn").over(Window.partitionBy(REQUEST))
    return df.withColumn("recent", F.when(known > 0, F.col("turn").isNotNull() & (by_turn <= recent)).otherwise(by_place <= 2 * recent))


#: Bits of the tally of n-grams, and its slices; members and classes that are verified together; pairs a task makes at a time,
#: and shared entries asked for beyond one.
_PLACES, _SLICES, _TILE, _CHUNK, _MET, _MORE = 22, 16, 1 << 20, 256, 1 << 20, 2


def _least(threshold: float, a, b):
    """Members that alike sets of a and b members share at least, a rounding error less rather than more."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-6).astype(np.int64)


def _tally(rows: DataFrame, n: int) -> np.ndarray:
    """How often n-grams occur, by the first bits of their hashes: rare ones come first in an index, and which count as rare
    decides on its cost only."""
    wide = (1 << _PLACES) // _SLICES

    def count(batches):
        total = np.zeros(1 << _PLACES, np.int64)
        for batch in batches:
            for _, sets in gram_sets(batch.column(1), _salts(batch.column(0)), n):
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - _PLACES)).astype(np.int64), minlength=1 << _PLACES)
        if total.any():
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(_SLICES, wide)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([pa.Codec("zstd").compress(p.tobytes(), asbytes=True) for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(pa.Codec("zstd").decompress(data, 2 * wide, asbytes=True), np.uint16)
                sums[k] = sums.get(k, np.zeros(wide, np.uint32)) + own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    parts = rows.select("__salt", "content").mapInArrow(count, "slice int, counts binary").repartition(_SLICES, "slice")
    out = np.zeros((_SLICES, wide), np.uint32)
    for row in parts.mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return out.reshape(-1)


def _salts(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _indexed(rows: DataFrame, key: str, threshold: float, n: int) -> DataFrame:
    """(key, pos, name, cid, m, index) of each row: its text's hash, its class, the size of its set of n-grams and the rarest
    of these, of which alike sets share one."""
    spark = rows.sparkSession
    tally = spark.sparkContext.broadcast(_tally(rows, n))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, "pos", "__name"))

    def index(batches):
        for batch in batches:
            ids, salts = [batch.column(k) for k in range(3)], _salts(batch.column(3))
            for i, sets in gram_sets(batch.column(4), salts, n):
                own_salts, size, sums, rare = salts[i : i + len(sets)], np.array([len(s) for s in sets], np.int64), [], []
                for own, salt in zip(sets, own_salts):
                    sums.append(mix(own + salt).sum(dtype=np.uint64))
                    length = len(own) - int(np.ceil(threshold * len(own) - 1e-6)) + 1 if len(own) else 0
                    often = tally.value[(own >> np.uint64(64 - _PLACES)).astype(np.int64)]
                    rare.append(own[np.lexsort((own, often))[:length]].view(np.int64))
                cid = mix(np.array(sums) + size.astype(np.uint64) * np.uint64(3) + mix(own_salts)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rare])], pa.int32()), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(sets)) for c in ids), pa.array(cid, pa.int64()), pa.array(size), lists], names=[key, "pos", "__name", "cid", "m", "index"])

    return rows.select(key, "pos", "__name", "__salt", "content").mapInArrow(index, f"{kinds}, cid long, m long, index array<long>")


def _met(index: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of classes that may be alike, from index entries (gram, cid, m, place), places by the order of the
    index.  Sets of p and q members that are alike share s, so of the first p - s + l and q - s + l they share l."""

    def pairs(batches):
        last, held, made, count = None, [], [], 0

        def packed():
            a, b, m, k = (np.concatenate(x) for x in zip(*made))
            order = np.lexsort((b, a))
            a, b, m, k = a[order], b[order], m[order], k[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(m[at]), pa.array(np.add.reduceat(k, at))], names=["a", "b", "need", "met"])

        def paired(x, y, m, larger, place, other):
            both = _least(threshold, m, larger)
            more = np.clip(both - np.ceil(threshold * larger - 1e-6).astype(np.int64), 0, _MORE)
            ok = (place <= m - both + more) & (other <= larger - both + more)
            x, y = np.broadcast_to(x, len(ok))[ok], y[ok]
            return np.minimum(x, y), np.maximum(x, y), more[ok] + 1, np.ones(len(x), np.int64)

        def lists(grams, cids, sizes, places):
            """Of lists of the same length together, of long ones one class with the rest."""
            order = np.lexsort((cids, sizes, grams))
            order = order[np.r_[True, (grams[order][1:] != grams[order][:-1]) | (cids[order][1:] != cids[order][:-1])]]
            grams, cids, sizes, places = grams[order], cids[order], sizes[order], places[order]
            at = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1], True])
            many, first = np.diff(at), at[:-1]
            for size in np.unique(many[(many > 1) & (many <= 32)]):
                i, j = (first[many == size][:, None] + k for k in np.triu_indices(size, 1))
                fits = sizes[j] <= sizes[i] / threshold + 1e-6
                i, j = i[fits], j[fits]
                if len(i):
                    yield paired(cids[i], cids[j], sizes[i], sizes[j], places[i], places[j])
            for low, high in zip(first[many > 32].tolist(), (first + many)[many > 32].tolist()):
                most = low + np.searchsorted(sizes[low:high], sizes[low:high] / threshold + 1e-6, side="right")
                for i in range(low, high - 1):
                    j = slice(i + 1, int(most[i - low]))
                    if j.start < j.stop:
                        yield paired(cids[i], cids[j], sizes[i], sizes[j], places[i], places[j])

        def whole(rest):
            """The held rows' lists, the last one stays behind unless rest."""
            columns = [np.concatenate(x) for x in zip(*held)]
            grams = columns[0]
            end = len(grams) if rest else int(np.searchsorted(grams, grams[-1]))
            held[:] = [[x[end:] for x in columns]]
            yield from lists(*(x[:end] for x in columns)) if end else ()

        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(own[0]):
                continue
            held.append(own)
            if last is None or own[0][-1] != last:
                last = own[0][-1]
                for x in whole(False):
                    made.append(x)
                    count += len(x[0])
                    if count >= _MET:
                        yield packed()
                        made, count = [], 0
        if held:
            for x in whole(True):
                made.append(x)
                count += len(x[0])
                if count >= _MET:
                    yield packed()
                    made, count = [], 0
        if made:
            yield packed()

    dealt = index.repartition("gram").sortWithinPartitions("gram").mapInArrow(pairs, "a long, b long, need long, met long")
    return dealt.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need")).filter("met >= need").select("a", "b")


def _compared(met: DataFrame, texts: DataFrame, found: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, similarity) of the pairs met that are alike.  Classes whose least partner is the same are compared together, as
    many as _TILE members or _CHUNK classes at a time: no set moves for each of its pairs.  found: (pos, __name, cid, m)
    of each row."""
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    unit = both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("cid")).alias("unit"))
    own = F.min(F.struct("pos", "__name", "m")).alias("row")
    placed = written(found.join(unit, "cid").groupBy("cid", "unit").agg(own).select("cid", "unit", "row.*"))
    parts = placed.groupBy("unit").agg(F.ceil(F.greatest(F.sum("m") / _TILE, F.count("*") / _CHUNK)).alias("parts"))
    spot = F.xxhash64("unit", F.pmod(F.xxhash64("cid"), "parts"))
    placed = placed.join(parts, "unit").select("cid", "pos", "__name", spot.alias("spot"))
    a, b = (placed.select(F.col("cid").alias(s), F.col("spot").alias(f"s{s}")) for s in "ab")
    tile = F.xxhash64(F.least("sa", "sb"), F.greatest("sa", "sb")).alias("tile")
    pairs = written(met.join(a, "a").join(b, "b").select(tile, "a", "b"))
    tiles = pairs.select("tile", F.col("a").alias("cid")).unionByName(pairs.select("tile", F.col("b").alias("cid"))).groupBy("cid").agg(F.collect_set("tile").alias("tiles"))
    wanted = placed.join(tiles, "cid").select(F.col("pos").alias("__pos"), F.col("__name").alias("__text"), "cid", "tiles")
    held = texts.join(wanted, F.col("pos").eqNullSafe(F.col("__pos")) & (F.col("__name") == F.col("__text"))).select("__salt", "content", "cid", "tiles")

    def sets(batches):
        for batch in batches:
            for i, some in gram_sets(batch.column(1), _salts(batch.column(0)), n):
                for cid, where, own in zip(batch.column(2)[i : i + len(some)].to_pylist(), batch.column(3)[i : i + len(some)].to_pylist(), some):
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([cid] * len(where), pa.int64()), pa.nulls(len(where), pa.int64()), pa.array([own.tobytes()] * len(where), pa.binary())], names=["tile", "a", "b", "members"])

    def compare(batches):
        at, ids, members, pairs_ = None, {}, [], {}

        def alike():
            size = np.array([len(x) for x in members])
            whole, owner = np.concatenate(members), np.repeat(np.arange(len(members)), size)
            order = np.argsort(whole, kind="stable")
            whole, owner = whole[order], owner[order]
            out = []
            for x, others in pairs_.items():
                i, js = ids[x], np.array([ids[y] for y in others])
                if len(js) < 8:
                    shared = np.array([np.isin(members[i], members[j], assume_unique=True).sum() for j in js])
                else:
                    low, high = np.searchsorted(whole, members[i]), np.searchsorted(whole, members[i], side="right")
                    count = high - low
                    hit = owner[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
                    shared = np.bincount(hit, minlength=len(members))[js]
                likeness = shared / (size[i] + size[js] - shared)
                ok = likeness >= threshold
                out.append((np.full(ok.sum(), x), np.array(others)[ok], likeness[ok]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.concatenate(c) for c in zip(*out)), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

        for batch in batches:
            for tile_, x, y, data in zip(*(c.to_pylist() for c in batch.columns)):
                if tile_ != at:
                    if pairs_:
                        yield alike()
                    at, ids, members, pairs_ = tile_, {}, [], {}
                if y is not None:
                    pairs_.setdefault(x, []).append(y)
                elif x not in ids:
                    ids[x] = len(members)
                    members.append(np.frombuffer(data, np.uint64))
        if pairs_:
            yield alike()

    moved = held.mapInArrow(sets, "tile long, a long, b long, members binary").unionByName(pairs.withColumn("members", F.lit(None).cast("binary")))
    return moved.repartition("tile").sortWithinPartitions("tile", F.col("b").isNotNull()).mapInArrow(compare, "a long, b long, similarity double")


def duplicate_classes(df: DataFrame, key: str, threshold: float = 0.85, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows of one group (key) with equal word n-grams are a class, named by its least pos.  (key, pos, rep) of each row,
    and (key, a, b, similarity), a < b: pairs of classes that are alike.  Texts without n-grams are alike to each other.

    N-grams and sets of them are 64-bit hashes.  An inverted index brings only classes together that share one of a class's
    rarest grams: of m grams two alike ones share some among the first m - ceil(threshold m) + 1 in any one order; the order
    here is by a tally of hashes.  Those that share as many of the first there as alike ones must are compared by their whole sets, which
    are made anew from the texts, so that only index entries of all texts move."""
    texts = df.select(key, "pos", F.coalesce("content", F.lit("")).alias("content")).withColumns({"__salt": F.xxhash64(key), "__name": F.xxhash64("content")})
    found = written(_indexed(texts, key, threshold, n))
    classes = found.groupBy("cid").agg(F.min("pos").alias("rep"), F.first(key).alias(key))
    members = found.select(key, "pos", "cid").join(classes.select("cid", "rep"), "cid").select(key, "pos", "rep")
    met = written(_met(found.select(F.posexplode("index").alias("place", "gram"), "cid", "m").select("gram", "cid", "m", "place"), threshold))
    alike = _compared(met, texts, found.select("pos", "__name", "cid", "m"), threshold, n)
    a, b = (classes.select(F.col("cid").alias(s), F.col("rep").alias(f"r{s}"), F.col(key).alias(f"k{s}")) for s in "ab")
    pairs = alike.join(a, "a").join(b, "b").filter(F.col("ka").eqNullSafe(F.col("kb")))
    return members, pairs.select(F.col("ka").alias(key), F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")


def duplicate_pairs(df: DataFrame, key: str, threshold: float = 0.85, n: int = 2) -> DataFrame:
    """(key, a, b, similarity), a before b: every pair of alike rows of a group.  A class of equal rows has its square in
    pairs here, so this is for groups as small as a request; duplicate_classes() is for large ones."""
    members, pairs = duplicate_classes(df, key, threshold, n)
    a, b = (members.select(key, F.col("rep").alias(f"r{s}"), F.col("pos").alias(s)) for s in "ab")
    pairs = pairs.select(key, F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    across = pairs.join(a, [key, "ra"]).join(b, [key, "rb"]).select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    own = a.join(b.withColumnRenamed("rb", "ra"), [key, "ra"]).filter("a < b").select(key, "a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(own)


def sweep(pairs: list[tuple[int, int]], rank: dict[int, tuple]) -> set[int]:
    """Places killed: pairs in order, both still alive; the one of lower rank dies, of equal rank the later one."""
    dead: set[int] = set()
    for a, b in sorted(pairs):
        if a not in dead and b not in dead:
            dead.add(a if rank[b] > rank[a] else b)
    return dead


#: Segments of a request that are compared within one task; a larger request's go through the index of
#: duplicate_classes().
TOGETHER = 500


def _alike(texts: list[str], threshold: float, n: int) -> list[tuple[int, int]]:
    """Places of the pairs of texts that are alike, by their word n-grams."""
    grams = []
    for text in texts:
        words = text.split()
        grams.append(set(zip(*(words[k:] for k in range(n)))))
    out = []
    for j, b in enumerate(grams):
        for i, a in enumerate(grams[:j]):
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                shared = len(a & b)
                if not a and not b or shared >= threshold * (len(a) + len(b) - shared):
                    out.append((i, j))
    return out


def near_copies(df: DataFrame, threshold: float = 0.85, n: int = 2) -> DataFrame:
    """(request_id, pos) of near copies within a request: the lower priority goes, then the lower score, then the later."""
    kind, place = df.schema[REQUEST].dataType.simpleString(), df.schema["pos"].dataType.simpleString()
    schema = f"{REQUEST} {kind}, pos {place}"
    rows = df.select(REQUEST, "pos", F.coalesce("content", F.lit("")).alias("content"), priority_weight().alias("weight"), F.coalesce("score", F.lit(0.0)).alias("s"))
    large = rows.groupBy(REQUEST).agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select(REQUEST)

    def dead(request, pos, pairs, weight, s) -> pd.DataFrame:
        gone = sorted(sweep([(pos[i], pos[j]) for i, j in pairs], {p: (w, x) for p, w, x in zip(pos, weight, s)}))
        return pd.DataFrame({REQUEST: [request] * len(gone), "pos": gone})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return dead(pdf[REQUEST].iloc[0], pdf["pos"].tolist(), _alike(pdf["content"].tolist(), threshold, n), pdf["weight"], pdf["s"])

    if not large.limit(1).count():
        return rows.groupBy(REQUEST).applyInPandas(together, schema)
    small = rows.join(large, REQUEST, "left_anti").groupBy(REQUEST).applyInPandas(together, schema)
    most = rows.join(large, REQUEST, "left_semi")
    ranks = most.select(REQUEST, "pos", "weight", "s")
    with_ranks = duplicate_pairs(most, REQUEST, threshold, n).join(ranks.toDF(REQUEST, "a", "wa", "sa"), [REQUEST, "a"]).join(ranks.toDF(REQUEST, "b", "wb", "sb"), [REQUEST, "b"])

    def kill(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = {a: (w, s) for a, w, s in zip(pdf["a"], pdf["wa"], pdf["sa"])} | {b: (w, s) for b, w, s in zip(pdf["b"], pdf["wb"], pdf["sb"])}
        gone = sorted(sweep(list(zip(pdf["a"], pdf["b"])), rank))
        return pd.DataFrame({REQUEST: [pdf[REQUEST].iloc[0]] * len(gone), "pos": gone})

    return small.unionByName(with_ranks.groupBy(REQUEST).applyInPandas(kill, schema))


def traced(after: DataFrame, before: DataFrame, method: str, prefix: str) -> DataFrame:
    """after with source_id, method and parents telling that it was made of all of before's segments of its request."""
    parents = before.groupBy(REQUEST).agg(F.array_sort(F.collect_list(F.struct("pos", "segment_id"))).alias("__parents"))
    parents = parents.select(F.col(REQUEST).alias("__request"), F.col("__parents.segment_id").alias("parents"))
    out = after.join(parents, F.col(REQUEST) == F.col("__request"), "left").drop("__request")
    return out.withColumn("source_id", F.concat(F.lit(prefix), "segment_id")).withColumn("method", F.lit(method))


def drop_near_copies(df: DataFrame, threshold: float = 0.85, n: int = 2, trace: bool = False) -> DataFrame:
    out = df.join(near_copies(df, threshold, n), [REQUEST, "pos"], "left_anti")
    return traced(out, df, f"dedup_jaccard_{n}gram", "dedup_") if trace else out


def truncate(df: DataFrame, target: int, strategy: str = "tail", head: float = 0.5, trace: bool = False) -> DataFrame:
    """Requests over target cut to it, by what is given up: the tail, the head or the middle."""
    cuts = {"tail": lambda: keep_head(df, target), "head": lambda: keep_tail(df, target), "middle": lambda: keep_ends(df, target, head)}
    if strategy not in cuts:
        raise ValueError(f"unknown strategy {strategy}")
    out = cuts[strategy]()
    if not trace:
        return out
    over = df.groupBy(REQUEST).agg(F.sum("token_count").alias("n")).filter(F.col("n") > target).select(REQUEST)
    whole = out.join(over, REQUEST, "left_anti").withColumn("method", F.lit(None).cast("string")).withColumn("parents", F.lit(None).cast("array<string>"))
    return whole.unionByName(traced(out.join(over, REQUEST, "left_semi"), df, f"truncation_{strategy}", "compressed_").select(whole.columns))


def summarise(df: DataFrame, provider: Callable[[str], str] | None, target: int | None = None, most: int | None = None) -> DataFrame:
    """One summary segment per request by provider, a function of its contents in order, each behind its type; the rest
    of its columns are the first segment's.  Where there is no provider, or it raises, and target is given, the request
    is cut to target tokens instead, else it is an error.  most: characters of a summary at most."""

    @F.pandas_udf("string")
    def told(values: pd.Series) -> pd.Series:
        def one(value: str) -> str | None:
            try:
                if provider is None:
                    raise ValueError("no provider")
                return provider(value).strip()[:most]
            except Exception:  # a provider's failure is the request's
                if target is None:
                    raise
                return None

        return values.map(one)

    each = F.concat(F.lit("["), F.upper("type"), F.lit("] "), "content")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", each.alias("text")))), lambda x: x["text"]), "\n\n")
    first = F.min_by(F.struct(*df.columns), "pos").alias("first")
    grouped = df.groupBy(REQUEST).agg(whole.alias("whole"), first, F.sum("token_count").alias("tokens_before")).withColumn("summary", told("whole"))
    made = {"content": F.col("summary"), "type": F.lit("summary"), "role": F.lit("assistant"), "source_id": F.concat(F.lit("summary_"), F.col("first.segment_id")), "token_count": F.floor(F.length("summary") / 4).cast("int"), "pos": F.lit(0)}
    done = grouped.filter("summary is not null").select(*[(made[c].cast(df.schema[c].dataType) if c in made else F.col(f"first.{c}")).alias(c) for c in df.columns], "tokens_before")
    if target is None:
        return done
    failed = grouped.filter("summary is null").select(REQUEST, "tokens_before")
    return done.unionByName(keep_head(df.join(failed.select(REQUEST), REQUEST, "left_semi"), target).drop("cut").join(failed, REQUEST).select(done.columns))


def _reordered(df: DataFrame, last: Column, active: Column) -> DataFrame:
    """df with the active requests' rows numbered anew, those for which last holds behind the others."""
    by = Window.partitionBy(REQUEST).orderBy(F.when(active & last, 1).otherwise(0), "pos")
    return df.withColumn("pos", F.when(active, F.row_number().over(by) - 1).otherwise(F.col("pos")).cast(df.schema["pos"].dataType))


def _step(slim: DataFrame, level: str, available: int) -> DataFrame:
    """One priority's segments cut to what the others leave, in requests that are over, by token and character counts."""
    w = Window.partitionBy(REQUEST)
    own = F.col("may") & (F.col("level") == level)
    out = slim.withColumns({"own": own, "step": F.col("active") & (F.sum("tokens").over(w) > available)})
    out = out.withColumns({"step": F.col("step") & (F.max(F.col("own").cast("int")).over(w) == 1), "goal": F.greatest(F.lit(0), F.lit(available) - F.coalesce(F.sum(F.when(~F.col("own"), F.col("tokens"))).over(w), F.lit(0)))})
    out = out.withColumn("within", F.col("own") & F.col("step"))
    along = Window.partitionBy(REQUEST, "within").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("upto", F.sum("tokens").over(along)).withColumn("rest", F.col("goal") - F.col("upto") + F.col("tokens"))
    over = F.col("within") & (F.col("upto") > F.col("goal"))
    out = out.withColumn("now", over).filter(~F.col("now") | (F.col("rest") > 0))
    size = F.floor(F.col("chars") * F.col("rest") / F.col("tokens"))
    out = out.withColumn("chars", F.when(F.col("now"), size).otherwise(F.col("chars")).cast("long")).filter(~F.col("now") | (F.col("chars") > 0))
    out = out.withColumns({"tokens": F.when(F.col("now"), F.col("rest")).otherwise(F.col("tokens")).cast("long"), "cut": F.col("cut") | F.col("now")})
    return _reordered(out, F.col("own"), F.col("step")).select(*slim.columns)


def cascade(df: DataFrame, available: int, threshold: float = 0.85, least: int = 50, on_over: str = "error", keep_must: bool = True) -> DataFrame:
    """df, and whether a segment was cut.  Requests at or over threshold lose near copies among the segments that may be
    compressed (see eligible()); then low, medium and high priority ones of these are cut to what the others leave, each
    step only while the request is over.  Protected segments are never touched and come first after a step.

    A request still over in the end is an error (CompressionError's message, from the executor), unless on_over is
    "keep"."""
    w = Window.partitionBy(REQUEST)
    may = F.coalesce(eligible(least, keep_must), F.lit(False))
    saturated = F.coalesce(F.sum("token_count").over(w) / available >= threshold, F.lit(False)) if available > 0 else F.lit(False)
    slim = df.select(REQUEST, "pos", F.col("pos").alias("place"), F.coalesce("token_count", F.lit(0)).cast("long").alias("tokens"), F.length("content").cast("long").alias("chars"), may.alias("may"), effective_priority().alias("level"), F.lit(False).alias("cut"), saturated.alias("active"))
    busy = slim.filter("active and may").select(F.col(REQUEST).alias("__request"), F.col("place").alias("__place"))
    gone = near_copies(df.join(busy, (F.col(REQUEST) == F.col("__request")) & (F.col("pos") == F.col("__place")), "left_semi"))
    out = slim.join(gone.withColumnRenamed("pos", "place"), [REQUEST, "place"], "left_anti").select(*slim.columns)
    out = out.withColumn("some", F.col("active") & (F.max(F.col("may").cast("int")).over(w) == 1))
    out = _reordered(out, F.col("may"), F.col("some")).drop("some")
    for level in ("low", "medium", "high"):
        out = _step(out, level, available)
    if on_over == "error":
        total = F.sum("tokens").over(w)
        message = F.concat(F.lit("CompressionError: request "), F.col(REQUEST).cast("string"), F.lit(f" is over {available} tokens after all steps"))
        out = out.withColumn("tokens", F.when(F.col("active") & (total > available), F.raise_error(message).cast("long")).otherwise(F.col("tokens")))
    found = out.select(F.col(REQUEST).alias("__request"), F.col("place").alias("__place"), F.col("pos").alias("__pos"), F.col("tokens").alias("__tokens"), F.col("chars").alias("__chars"), "cut")
    both = df.drop("cut").join(found, (F.col(REQUEST) == F.col("__request")) & (F.col("pos") == F.col("__place")))
    made = {"pos": F.col("__pos").cast(df.schema["pos"].dataType), "content": F.when(F.col("cut"), F.substring("content", F.lit(1), F.col("__chars").cast("int"))).otherwise(F.col("content")), "token_count": F.when(F.col("cut") | F.lit(on_over == "error"), F.col("__tokens")).otherwise(F.col("token_count")).cast("int")}
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns if c != "cut"], "cut")
