"""Removal of repeated passages by level-wise doubling.

A window of w words that occurs twice brings with it, twice, each shorter sequence inside it.  So sequences of
b = w/4 words are looked at first, and not all of them: in every window the one with the least hash (equal windows
choose alike), a few hundredths of all places.  Those that occur once in all texts rule out every window that chose
them.  The rest are extended to 2b words, to the left and to the right, one of which lies inside any window that chose
the place; those repeated neither way go too.  What survives is extended to whole windows, whose repetition decides.

Each level is one exchange of hashes by blocks (see blocks.repeated): texts stay where they are, in blocks bucketed by
their number.  Hashes have 64 bits; a false repetition needs two different windows with one hash that also passed both
levels before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.blocks import TOP, blocks_of, known, repeated, sliding, unzipped, zipped
from ctxloom.llm.common import stage_bucketed, table
from ctxloom.llm.wordhash import gram_hashes, word_bounds, word_hashes

WINDOW = 35


class _Words:
    """The word sequences of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = word_bounds(data, offsets)
        self.hashes = word_hashes(data, starts, ends)
        self.stop = np.repeat(self.first[1:], np.diff(self.first))
        self.begin = np.repeat(self.first[:-1], np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each place, TOP where the text ends before."""
        out = np.full(len(self.hashes), TOP)
        found = gram_hashes(self.hashes, k)
        out[: len(found)] = found
        out[np.arange(len(out)) + k > self.stop] = TOP
        return out

    def chosen(self, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of base words at each place, the least of each window (0: no window), the places chosen."""
        short = self.grams(base)
        width = window - base + 1
        least = sliding(short, width, np.minimum, TOP)
        least[np.arange(len(least)) + window > self.stop] = 0
        most = sliding(least[::-1], width, np.maximum, np.uint64(0))[::-1]
        return short, least, np.flatnonzero((most == short) & (short != TOP))


def _levels(window: int) -> tuple[int, int]:
    base = max(1, -(-window // 4))
    return base, min(2 * base, window)


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(unzipped(row["texts"]), np.uint8), np.frombuffer(row["offsets"], np.int64)


DONE = "array<struct<id:long,words:long,removed:long,sha:string>>"


def _result(ident, text: bytes, gone: np.ndarray | None) -> dict:
    words = text.split()
    if gone is not None:
        words_kept = [w for w, g in zip(words, gone.tolist()) if not g]
    else:
        words_kept = words
    return {"id": ident, "words": len(words), "removed": len(words) - len(words_kept), "sha": hashlib.sha256(b" ".join(words_kept)).hexdigest()}


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    Rows that repeat an id or a text count as further places.  Null and empty texts have no words and keep the empty
    text; texts shorter than the window keep all.  No rows: no rows."""
    if window < 2:
        raise ValueError("a window has two words at least")
    base, double = _levels(window)
    done_type = pa.list_(pa.struct([("id", pa.int64()), ("words", pa.int64()), ("removed", pa.int64()), ("sha", pa.string())]))

    def first(batches):
        for number, ids, data, offsets in blocks_of(batches):
            words = _Words(data, offsets)
            short, _, at = words.chosen(window, base)
            two = words.grams(double)
            left = np.full(len(at), TOP)
            inside = at - (double - base) >= words.begin[at]
            left[inside] = two[at[inside] - (double - base)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([zipped(data.tobytes())], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (short[at], left, two[at]))],
                names=["block", "ids", "texts", "offsets", "short", "before", "after"],
            )

    texts = stage_bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, "block long, ids array<long>, texts binary, offsets binary, short binary, before binary, after binary"), "texts", "block")

    def second(batches):
        for batch in batches:
            for row in batch.to_pylist():
                short, before, after = (np.frombuffer(row[k], np.uint64) for k in ("short", "before", "after"))
                at = np.flatnonzero(known(row["found"], short))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([np.r_[before[at], after[at]].tobytes()], pa.binary())], names=["block", "kept", "both"])

    level1 = texts.select("block", "short", "before", "after").join(repeated(texts, "short").drop("totals"), "block").mapInArrow(second, "block long, kept binary, both binary")
    level1 = stage_bucketed(level1, "level1", "block")
    level2 = level1.join(repeated(level1, "both").drop("totals"), "block").select("block", "kept", "both", "found")

    def third(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = _texts(row)
                words = _Words(data, offsets)
                short, least, at = words.chosen(window, base)
                if row["kept"]:
                    kept, both = np.frombuffer(row["kept"], np.uint32), np.frombuffer(row["both"], np.uint64)
                    half = len(both) // 2
                    good = known(row["found"], np.where(both == TOP, np.uint64(0), both))
                    at = at[kept[good[:half] | good[half:]]]
                else:
                    at = at[:0]
                alive = np.full(len(short), TOP)
                alive[at] = short[at]
                starts = np.flatnonzero((sliding(alive, window - base + 1, np.minimum, TOP) == least) & (least > 0) & (least < TOP))
                full = gram_hashes(words.hashes, window)[starts] if len(starts) else np.zeros(0, np.uint64)
                touched = np.zeros(len(offsets) - 1, dtype=bool)
                touched[np.searchsorted(words.first, starts, side="right") - 1] = True
                ids = row["ids"]
                done = [_result(ids[i], data[offsets[i] : offsets[i + 1]].tobytes(), None) for i in np.flatnonzero(~touched)]
                some = np.flatnonzero(touched)
                # Places are told anew, within the texts that go on.
                kept_words = np.r_[0, np.cumsum(np.where(touched, np.diff(words.first), 0))]
                owner = np.searchsorted(words.first, starts, side="right") - 1
                starts = starts - words.first[owner] + kept_words[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([[ids[i] for i in some]], pa.list_(pa.int64())), pa.array([zipped(b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in some))], pa.binary()), pa.array([np.r_[0, np.cumsum(np.diff(offsets)[some])].astype(np.int64).tobytes()], pa.binary()), pa.array([starts.astype(np.uint32).tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary()), pa.array([done], done_type)],
                    names=["block", "ids", "texts", "offsets", "starts", "full", "done"],
                )

    level3 = texts.select("block", "ids", "texts", "offsets").join(level2, "block", "left").mapInArrow(third, f"block long, ids array<long>, texts binary, offsets binary, starts binary, full binary, done {DONE}")
    level3 = stage_bucketed(level3, "level3", "block")

    def last(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = _texts(row)
                starts, full = np.frombuffer(row["starts"], np.uint32).astype(np.int64), np.frombuffer(row["full"], np.uint64)
                starts = starts[known(row["found"], full)]
                _, _, bounds = word_bounds(data, offsets)
                cover = np.zeros(int(bounds[-1]) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                done = [_result(ident, data[offsets[i] : offsets[i + 1]].tobytes(), gone[bounds[i] : bounds[i + 1]]) for i, ident in enumerate(row["ids"])]
                yield pa.RecordBatch.from_arrays([pa.array([done], done_type)], names=["done"])

    rest = level3.select("block", "ids", "texts", "offsets", "starts", "full").filter("size(ids) > 0").join(repeated(level3, "full").drop("totals"), "block", "left").select("ids", "texts", "offsets", "starts", "full", "found").mapInArrow(last, f"done {DONE}")
    rows = level3.select("done").unionByName(rest)
    return rows.select(F.explode("done").alias("d")).select(F.col("d.id").alias("doc_id"), F.col("d.words").alias("n_words"), F.col("d.removed").alias("n_removed"), F.col("d.sha").alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"))
