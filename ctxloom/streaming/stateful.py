"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(points: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per tumbling window and event type: count, sum, least and greatest value.  Works on streams and on tables."""
    rows = points.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "least", "greatest")


def rolling_summaries(messages: DataFrame, provider: Callable[[str, str], str], recent: int = 2) -> DataFrame:
    """Streams of (request_id, turn, content): each conversation's state is a summary of its turns but the last
    `recent`, which provider(summary, text) folds in as they age.  Emits (request_id, summary, folded, held)."""

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        summary, folded, turns, texts = state.get if state.exists else ("", 0, [], [])
        rows = sorted([*zip(turns, texts), *((int(t), c) for pdf in frames for t, c in zip(pdf["turn"], pdf["content"]))])
        last = sorted({t for t, _ in rows})[-recent:]
        for t, text in rows:
            if t not in last:
                summary, folded = provider(summary, text), folded + 1
        held = [(t, c) for t, c in rows if t in last]
        state.update((summary, folded, [t for t, _ in held], [c for _, c in held]))
        yield pd.DataFrame({"request_id": [key[0]], "summary": [summary], "folded": [folded], "held": [len(held)]})

    kind = messages.schema["request_id"].dataType.simpleString()
    return messages.groupBy("request_id").applyInPandasWithState(fold, f"request_id {kind}, summary string, folded long, held long", "summary string, folded long, turns array<long>, texts array<string>", "update", "NoTimeout")


def turn_ages(messages: DataFrame, current_turn: int, ttl: int) -> DataFrame:
    """Streams of (request_id, turn, ...): rows with the age of their turn, two messages a turn, while it is under ttl."""
    return messages.withColumn("age", F.lit(current_turn) - F.floor(F.col("turn") / 2)).filter(F.col("age") < ttl)


def expiring_cache(puts: DataFrame, seconds: int = 600) -> DataFrame:
    """Streams of (key, ts), in order for each key: (key, created) of each entry made: the first put of a key, and each
    first one after the entry before has lived for so many seconds."""

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        created = state.get[0] if state.exists else None
        made = []
        for ts in sorted(int(t) for pdf in frames for t in pdf["at"]):
            if created is None or ts >= created + seconds * 1_000_000:
                created = ts
                made.append(ts)
        state.update((created,))
        yield pd.DataFrame({"key": [key[0]] * len(made), "at": pd.Series(made, dtype="int64")})

    kind = puts.schema["key"].dataType.simpleString()
    rows = puts.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = rows.groupBy("key").applyInPandasWithState(keep, f"key {kind}, at long", "created long", "append", "NoTimeout")
    return found.select("key", F.timestamp_micros("at").alias("created"))


def recent_history(events: DataFrame, most: int = 100) -> DataFrame:
    """Streams of (agent, event_id, ts): each agent's last `most` events, kept in state."""

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        held = sorted({*held, *((int(i), str(t)) for pdf in frames for i, t in zip(pdf["event_id"], pdf["ts"]))}, key=lambda e: (e[1], e[0]))[-most:]
        state.update(([i for i, _ in held], [t for _, t in held]))
        yield pd.DataFrame({"agent": [key[0]], "events": [len(held)], "last": [held[-1][0] if held else -1]})

    kind = events.schema["agent"].dataType.simpleString()
    return events.groupBy("agent").applyInPandasWithState(keep, f"agent {kind}, events long, last long", "ids array<long>, times array<string>", "update", "NoTimeout")
