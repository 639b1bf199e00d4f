"""Exact Jaccard join of word-shingle sets with adaptive multi-match prefixes, and its components.

Two sets of Jaccard 0.8 or more share o = ceil(0.8 n) members of either.  Under any one order of all members, sets that
share o of them share l among the first n - o + l of each (l = 1, 2, ...).  A longer prefix costs more index entries but
asks for more matches before a pair is verified.

1. Sieve.  With the hash as order and l = n/20, each document's prefix goes through an exchange by blocks; a document
   of which fewer prefix members are repeated anywhere than any partner would need is linked with nothing.
2. Equal sets become classes.  For the classes' whole sets a second exchange counts members; a class with fewer than o
   repeated members goes.  The order is now by that count, rare first, and each class chooses the l of least estimated
   cost: the entries it will meet, and the pairs those can make, weighed by the cost of verifying one.
3. Links.  Members of a group that are already joined need no further link, so rounds of stars come first: in each
   index list one class is the pivot (first the one with the fewest members of its own, the likely original) and
   every class is verified with the pivot it meets most.  Then every pair of classes of two components that matches in
   l places, the lesser of the two classes' l, is verified: pairs of short lists as rows, those that meet in a long
   list in tiles (see _tiles).  So no link between components is lost, and a group of copies is never expanded into
   its pairs.  near_links() leaves the stars out and gives every link between classes.

Verification compares the whole sets of 64-bit hashes.  Components are spread by least labels with pointer jumping;
links, labels and sets stay distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.blocks import blocks_of, known, repeated, unzipped, zipped
from ctxloom.llm.common import partitions, stage, stage_bucketed, table
from ctxloom.llm.wordhash import gram_hashes, mix, word_bounds, word_hashes

SHINGLE = 5
PERCENT = 80
#: Rounds of stars before the remaining pairs, index entries of a long list, classes of a chunk, pairs of one class that
#: are verified together.
STARS, HOT, CHUNK, SPREAD = 2, 32, 1024, 256
#: Cost of verifying a pair, in index entries, for each member of a set.
VERIFY = 0.05
#: Lengths of match tried.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
_PLACE = 21
IDENT = pa.struct([("doc_id", pa.int64()), ("name", pa.int64())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the sets' bounds."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    count = np.diff(first)
    grams = np.zeros(len(words), np.uint64)
    found = gram_hashes(words, k)
    grams[: len(found)] = found
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    for i in np.flatnonzero((count > 0) & (count < k)):
        grams[first[i]] = gram_hashes(words[first[i] : first[i + 1]], int(count[i]))[0]
    place = np.arange(len(words)) - np.repeat(first[:-1], count)
    grams = grams[place < np.repeat(size, count)]
    bounds = np.r_[0, np.cumsum(size)]
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams[low:high].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    new[bounds[:-1][size > 0]] = True
    owner = np.repeat(np.arange(len(size)), size)
    return grams[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(size)))].astype(np.int64)


def overlap(n):
    """Members that a set of n must share with a partner."""
    return (PERCENT * n + 99) // 100


def sieve_match(n):
    return np.maximum(1, n // 20)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _inside(bounds: np.ndarray) -> np.ndarray:
    """Each member's place within its set."""
    size = np.diff(bounds)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)


def _sieved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks, and (doc_id, name, n, c0, c1, cid, alive) of each row: name is its text's hash, c0 and c1 name the
    set, cid the row."""

    def first(batches):
        for number, ids, data, offsets in blocks_of(batches):
            grams, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            length = np.where(n > 0, n - overlap(n) + np.minimum(sieve_match(n), overlap(n)), 0)
            prefix = grams[_inside(bounds) < np.repeat(length, n)]
            c0, c1 = _sums(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds), _sums(mix(grams + np.uint64(0x5851F42D4C957F2D)), bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(IDENT)), pa.array([zipped(data.tobytes())], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (offsets, n.astype(np.int64), length.astype(np.int64), prefix, c0, c1))],
                names=["block", "ids", "texts", "offsets", "sizes", "lengths", "prefix", "c0", "c1"],
            )

    kinds = "block long, ids array<struct<doc_id:long,name:long>>, texts binary, offsets binary, sizes binary, lengths binary, prefix binary, c0 binary, c1 binary"
    ident = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("name"))
    blocks = stage_bucketed(docs.select(ident.alias("ident"), "text").mapInArrow(first, kinds), "shingles", "block")

    def second(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, length = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["lengths"], np.int64)
                hit = known(row["found"], np.frombuffer(row["prefix"], np.uint64))
                matches = _sums(hit.astype(np.int64), np.r_[0, np.cumsum(length)])
                alive = (n > 0) & (matches >= sieve_match(overlap(n)))
                cid = (row["block"] << _PLACE) + np.arange(len(n))
                ids = pa.array(row["ids"], IDENT)
                yield pa.RecordBatch.from_arrays([*ids.flatten(), pa.array(n), pa.array(np.frombuffer(row["c0"], np.int64)), pa.array(np.frombuffer(row["c1"], np.int64)), pa.array(cid), pa.array(alive)], names=["doc_id", "name", "n", "c0", "c1", "cid", "alive"])

    rows = blocks.select("block", "ids", "sizes", "lengths", "prefix", "c0", "c1").join(repeated(blocks, "prefix").drop("totals"), "block", "left")
    return blocks, stage(rows.mapInArrow(second, "doc_id long, name long, n long, c0 long, c1 long, cid long, alive boolean"), "sieved")


def choose(n: int, counts: np.ndarray) -> tuple[int, int]:
    """The l of least cost and how many of the repeated members (counts, rare first) its prefix holds."""
    o = overlap(n)
    alone = n - len(counts)
    sums = np.r_[0, np.cumsum(counts.astype(np.int64) - 1)]
    best = None
    for match in MATCHES:
        if match > o:
            break
        length = max(0, n - o + match - alone)
        entries = int(sums[min(length, len(counts))])
        cost = entries + length + VERIFY * n * entries / match
        if best is None or cost < best[0]:
            best = cost, match, length
    return best[1], best[2]


def _indexed(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, l, alone double, members binary, index array<long>) of each class that may have a partner."""
    chosen = classes.select(F.shiftright("cid", _PLACE).alias("block"), F.col("cid").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int").alias("place")).groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def sets(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = np.frombuffer(unzipped(row["texts"]), np.uint8), np.frombuffer(row["offsets"], np.int64)
                some = row["places"]
                part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in some])
                grams, bounds = shingle_sets(part, np.r_[0, np.cumsum(np.diff(offsets)[some])])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([some], pa.list_(pa.int32())), pa.array([bounds.tobytes()], pa.binary()), pa.array([grams.tobytes()], pa.binary())], names=["block", "places", "bounds", "members"])

    held = stage_bucketed(blocks.select("block", "texts", "offsets").join(chosen, "block").mapInArrow(sets, "block long, places array<int>, bounds binary, members binary"), "sets", "block")

    def index(batches):
        for batch in batches:
            for row in batch.to_pylist():
                members, bounds = np.frombuffer(row["members"], np.uint64), np.frombuffer(row["bounds"], np.int64)
                found = np.concatenate([np.frombuffer(f, np.uint64) for f in row["found"]])
                totals = np.concatenate([np.frombuffer(t, np.uint32) for t in row["totals"]])
                order = np.argsort(found)
                found, totals = found[order], totals[order]
                at = np.searchsorted(found, members).clip(max=len(found) - 1)
                count = np.where(found[at] == members, totals[at], 1)
                out = []
                for place, low, high in zip(row["places"], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own, times = members[low:high], count[low:high]
                    shared = own[times > 1]
                    if len(shared) < overlap(high - low):
                        continue
                    rare = np.lexsort((shared, times[times > 1]))
                    match, length = choose(high - low, times[times > 1][rare])
                    out.append(((row["block"] << _PLACE) + place, high - low, match, 1 - len(shared) / (high - low), own.tobytes(), shared[rare][:length].view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64())])], names=["cid", "n", "l", "alone", "members", "index"])

    return stage(held.join(repeated(held, "members"), "block").mapInArrow(index, "cid long, n long, l int, alone double, members binary, index array<long>"), "indexed")


def linked(x: bytes, y: bytes) -> bool:
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; sets: (cid, members).  A class may be the a of most pairs, as a star's pivot is: its
    set goes to a part for each SPREAD of them."""

    @F.pandas_udf("boolean")
    def link(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(*both) for both in zip(x, y)], dtype=bool)

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    own = sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")).join(parts, "a").select("a", "ma", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    with_b = pairs.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")
    return with_b.join(own, ["a", "part"]).filter(link("ma", "mb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges (a, b) reach, for every node that has an edge to a lesser label."""
    both = stage(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("far")), "other").groupBy("node").agg(F.min("far").alias("far"))
        spread = labels.join(near, "node").select("node", F.least("label", "far").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (cid, label) after joining the components of linked classes (a, b)."""
    ends = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = components(ends)
    return stage(labels.join(moved.toDF("label", "to"), "label", "left").select("cid", F.coalesce("to", "label").alias("label")), "labels")


def _fits(a, b):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _class_labels(indexed: DataFrame) -> DataFrame:
    """(cid, label) of all indexed classes."""
    sets = indexed.select("cid", "members")
    postings = indexed.select("cid", "n", "l", "alone", F.explode("index").alias("member"))
    labels = indexed.select("cid", F.col("cid").alias("label"))
    for turn in range(STARS):
        known_ = postings.join(labels, "cid") if turn else postings.withColumn("label", F.col("cid"))
        pivots = known_.groupBy("member").agg(F.min_by(F.struct("cid", "n", "label"), F.struct(*(["alone"] if turn == 0 else []), F.xxhash64("cid", F.lit(turn)))).alias("p"), F.count("*").alias("many")).filter("many > 1")
        met = known_.join(pivots, "member").filter((F.col("p.label") != F.col("label")) & _fits(F.col("p.n"), F.col("n")))
        counted = met.groupBy("cid", F.col("p.cid").alias("pivot")).agg(F.count("*").alias("matches"))
        best = counted.groupBy("cid").agg(F.max_by("pivot", F.struct("matches", "pivot")).alias("pivot"))
        labels = _merge(labels, stage(_verified(best.select(F.col("pivot").alias("a"), F.col("cid").alias("b")), sets), "links"))
    return _merge(labels, stage(_links(postings.join(labels, "cid"), sets, False), "links"))


def _links(entries: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Links (a, b) between classes of different labels, from index entries (cid, n, l, label, member): of two labels
    enough to join them, or every one, some maybe twice."""
    lists = stage(entries.groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high").select("member", "size"), "lists")
    entries = stage(entries.join(lists, "member"), "entries")
    cold = entries.filter(F.col("size") <= HOT)
    left, right = (cold.select("member", *(F.col(c).alias(f"{c}{s}") for c in ("cid", "n", "l", "label"))) for s in "ab")
    met = left.join(right, "member").filter((F.col("cida") < F.col("cidb")) & (F.col("labela") != F.col("labelb")) & _fits(F.col("na"), F.col("nb")))
    pairs = met.groupBy(F.col("cida").alias("a"), F.col("cidb").alias("b")).agg(F.count("*").alias("matches"), F.min(F.least("la", "lb")).alias("need")).filter("matches >= need").select("a", "b")
    return _verified(pairs, sets).unionByName(_tiles(entries.filter(F.col("size") > HOT), sets, every))


def tile_links(cids, labels, sets: list[np.ndarray], sides: np.ndarray, every: bool = False) -> list[tuple[int, int]]:
    """Links between sets of different labels, one side with the other (or all with all on one side), no more than
    join the labels, or every one: pairs of cids."""
    root = {label: label for label in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = np.array([len(s) for s in sets])
    other = np.flatnonzero(sides == sides.max())
    members = np.concatenate([sets[i] for i in other])
    owner = np.repeat(np.arange(len(other)), n[other])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    out = []
    for i in np.flatnonzero(sides == sides.min()):
        low, high = np.searchsorted(members, sets[i]), np.searchsorted(members, sets[i], side="right")
        size = high - low
        hit = owner[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        shared = np.bincount(hit, minlength=len(other))
        for j in other[100 * shared >= PERCENT * (n[i] + n[other] - shared)]:
            if every:
                if cids[i] != cids[j]:
                    out.append((cids[i], cids[j]))
                continue
            x, y = find(labels[i]), find(labels[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((cids[i], cids[j]))
    return out


def _tiles(entries: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Links (a, b) between classes that meet in a long list.

    Long lists that a class has in common are a cluster.  Where the squares of a cluster's lists add up to less than its
    own, as where one passage chains many lists, its lists are compared one by one, else the cluster as a whole.  Either
    is cut into bands of set sizes, of which only neighbours can hold a link, and a band's classes are dealt into chunks
    of CHUNK; each two chunks are a tile, compared within a task: no row is made for a pair that doesn't link, and, unless
    every link is asked for, of those that do only enough to join their labels."""
    if not entries.limit(1).count():
        return entries.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    lowest = entries.groupBy("cid").agg(F.min("member").alias("low"))
    named = components(entries.join(lowest, "cid").select(F.col("low").alias("a"), F.col("member").alias("b")).distinct())
    lists = entries.groupBy("member").agg(F.count("*").alias("size")).join(named.toDF("member", "cluster"), "member", "left").withColumn("cluster", F.coalesce("cluster", "member"))
    lists = stage(lists, "clusters")
    whole = entries.select("cid", "n", "label", "member").join(lists.select("member", "cluster"), "member").groupBy("cluster", "cid").agg(F.first("n").alias("n"), F.first("label").alias("label"))
    whole = stage(whole, "clustered")
    cost = lists.groupBy("cluster").agg(F.sum(F.pow(F.col("size").cast("double"), F.lit(2.0))).alias("apart"))
    cost = cost.join(whole.groupBy("cluster").agg(F.count("*").alias("classes")), "cluster").select("cluster", (F.col("apart") < F.pow(F.col("classes").cast("double"), F.lit(2.0))).alias("split"))
    single = entries.select("cid", "n", "label", "member").join(lists.join(cost.filter("split"), "cluster").select("member"), "member").withColumnRenamed("member", "unit")
    joined = whole.join(cost.filter("not split"), "cluster").select("cid", "n", "label", F.col("cluster").alias("unit"))
    own = stage(single.unionByName(joined).withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")), "banded")
    sizes = stage(own.groupBy("unit", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "bands")
    near = sizes.select("unit", "band", "chunks")
    for step, name in ((-1, "below"), (1, "above")):
        near = near.join(sizes.select("unit", (F.col("band") - step).alias("band"), F.col("chunks").alias(name)), ["unit", "band"], "left")
    dealt = own.join(near, ["unit", "band"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), "chunks").cast("int")).join(sets, "cid")

    def code(band, chunk):
        return F.shiftleft(band.cast("long"), 32) + chunk

    def chunks_of(count, step):
        found = F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: code(F.col("band") + step, k))
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, found).otherwise(F.array().cast("array<long>"))

    others = F.concat(chunks_of("chunks", 0), chunks_of("below", -1), chunks_of("above", 1))
    dealt = dealt.select("unit", code(F.col("band"), F.col("chunk")).alias("own"), F.explode(others).alias("with"), "cid", "label", "members")
    dealt = dealt.select("unit", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "cid", "label", "members")

    def run(batches):
        tile, rows = None, []

        def links():
            cids, labels, raw, chunks = zip(*rows)
            found = tile_links(cids, labels, [np.frombuffer(m, np.uint64) for m in raw], np.array(chunks), every) if len(set(labels)) > 1 and (tile[1] == tile[2] or len(set(chunks)) == 2) else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for unit, i, j, own, cid, label, members in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, i, j) != tile:
                    if rows:
                        yield links()
                    tile, rows = (unit, i, j), []
                rows.append((cid, label, members, own))
        if rows:
            yield links()

    return dealt.repartition(partitions(entries), "unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks, the rows, and (c0, c1, cid, least) of each set that may have a partner."""
    blocks, rows = _sieved(docs)
    return blocks, rows, stage(rows.filter("alive").groupBy("c0", "c1").agg(F.min("cid").alias("cid"), F.min("doc_id").alias("least")), "classes")


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members): a pair of classes (a, b), a < b, for every two different sets that link, and (doc_id, n_shingles,
    class_id) of each row of docs.  Rows of one class have one set and are linked; rows without words have no class.  A
    class's links are as many as its near texts, so a group of many near texts has their square in rows here; see
    near_duplicates() for components alone.  No rows: no rows."""
    blocks, rows, classes = _classes(docs)
    indexed = _indexed(blocks, classes)
    entries = indexed.select("cid", "n", "l", F.col("cid").alias("label"), F.explode("index").alias("member"))
    found = _links(entries, indexed.select("cid", "members"), True)
    links = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    members = rows.join(classes.select("c0", "c1", F.col("cid").alias("class")), ["c0", "c1"], "left")
    return links, members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class", "cid")).alias("class_id"))


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n_shingles, component, component_id), one row per row of docs: name is the hash (xxhash64) of the
    row's text, component a number of the row's component; the rest is as in near_duplicates()."""
    blocks, rows, classes = _classes(docs)
    labels = _class_labels(_indexed(blocks, classes))
    whole = classes.join(labels, "cid", "left").select("c0", "c1", "least", F.coalesce("label", "cid").alias("label"))
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "label").select("c0", "c1", F.col("label").alias("component"), "component_id")
    alone = rows.filter("not alive").select("doc_id", "name", F.col("n").alias("n_shingles"), F.col("cid").alias("component"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(rows.filter("alive").join(named, ["c0", "c1"]).select("doc_id", "name", F.col("n").alias("n_shingles"), "component", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    Null, empty and wordless texts have no shingles and are linked with nothing; long texts are taken whole.  Rows with
    one set are linked whatever their ids.  component_id is the least doc_id of the component; null ids count only where
    there is no other.  No rows: no rows."""
    return near_rows(docs).select("doc_id", "n_shingles", "component_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
