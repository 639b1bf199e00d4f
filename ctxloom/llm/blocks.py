"""Blocks of texts, and the exchange that tells each block which of its hashes occur elsewhere.

A block is a run of one task's rows with about BLOCK bytes of text, kept as one row; its number and the places within
it name documents and words from then on, whatever their ids are.  The exchange deals a block's distinct hashes to
ranges, a range finds those that came more than once, and each block gets back its own.  A hash that a third of all
rows share is one entry per block, so no range grows with it, and no pairs of rows are ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import partitions
from ctxloom.llm.wordhash import slices, text_buffer

BLOCK = 2 << 20
#: Hashes a task gathers before it deals them.
GATHER = 2 << 20
TOP = np.uint64(2**64 - 1)


def zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def blocks_of(batches):
    """(number, ids, data, offsets) of each block of (doc_id, text) batches."""
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, BLOCK):
            low = int(offsets[i])
            yield number, batch.column(0).slice(i, j - i), data[low : int(offsets[j])], offsets[i : j + 1] - low
            number += 1


def repeated(blocks: DataFrame, hashes: str) -> DataFrame:
    """(block, found, totals): which of the block's uint64 hashes (a binary column) occur more than once in all blocks,
    and how often (uint32; a block counts 255 times at most), as binary arrays of one order; blocks without any are
    missing."""
    n = partitions(blocks)
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)

    def deal(batches):
        held, size = [], 0

        def rows():
            parts = [[] for _ in range(n)]
            for block, hashed, many in held:
                at = [0, *np.searchsorted(hashed, edges).tolist(), len(hashed)]
                for r in range(n):
                    if at[r] < at[r + 1]:
                        parts[r].append((block, hashed[at[r] : at[r + 1]], many[at[r] : at[r + 1]]))
            out = [(r, [p[0] for p in own], [len(p[1]) for p in own], b"".join(p[1].tobytes() for p in own), b"".join(p[2].tobytes() for p in own)) for r, own in enumerate(parts) if own]
            for i in range(0, len(out), 16):
                columns = list(zip(*out[i : i + 16]))
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "blocks", "sizes", "hashes", "many"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, counts = np.unique(np.frombuffer(data.as_buffer(), np.uint64), return_counts=True)
                held.append((block, found, np.minimum(counts, 255).astype(np.uint8)))
                size += len(found)
                if size >= GATHER:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    def meet(batches):
        at, held = None, []

        def rows():
            hashed = np.concatenate([np.frombuffer(h, np.uint64) for _, _, h, _ in held])
            many = np.concatenate([np.frombuffer(m, np.uint8) for *_, m in held])
            order = np.argsort(hashed, kind="stable")
            ordered = hashed[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            group = np.cumsum(new) - 1
            total = np.zeros(len(hashed), np.uint32)
            total[order] = np.bincount(group, weights=many[order])[group]
            hit = total > 1
            out, low = [], 0
            for blocks_, sizes, _, _ in held:
                for block, size in zip(blocks_, sizes):
                    own = hit[low : low + size]
                    if own.any():
                        out.append((block, hashed[low : low + size][own].tobytes(), total[low : low + size][own].tobytes()))
                    low += size
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096]), [pa.int64(), pa.binary(), pa.binary()])], names=["block", "found", "totals"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != at and held:
                    yield from rows()
                    held = []
                at = row[0]
                held.append(row[1:])
        if held:
            yield from rows()

    dealt = blocks.select("block", F.col(hashes).alias("hashes")).mapInArrow(deal, "range int, blocks array<long>, sizes array<int>, hashes binary, many binary")
    met = dealt.repartition(n, "range").sortWithinPartitions("range").mapInArrow(meet, "block long, found binary, totals binary")
    both = F.collect_list(F.struct("found", "totals"))
    return met.groupBy("block").agg(both.alias("both")).select("block", F.col("both.found").alias("found"), F.col("both.totals").alias("totals"))


def known(found, values: np.ndarray) -> np.ndarray:
    """Whether each value is among a block's found hashes (None: none are)."""
    if not found:
        return np.zeros(len(values), dtype=bool)
    return np.isin(values, np.concatenate([np.frombuffer(f, np.uint64) for f in found]))


def sliding(values: np.ndarray, width: int, op, rest) -> np.ndarray:
    """op over values[i : i + width], beyond the end taken as rest."""

    def ahead(a, k):
        out = np.full_like(a, rest)
        if k < len(a):
            out[: len(a) - k] = a[k:]
        return out

    out, done = values, 1
    while done * 2 <= width:
        out = op(out, ahead(out, done))
        done *= 2
    return op(out, ahead(out, width - done)) if done < width else out
