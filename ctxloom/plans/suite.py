"""Spans of builds, and one object for what is kept about them: snapshots, metrics, differences, golden checks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ctxloom.operators import inspect
from ctxloom.sources import store


class Spans:
    """Named spans with times, a parent, a status and attributes, in the order they end; emit gets each as it ends."""

    SCHEMA = "name string, parent string, start double, stop double, status string, attributes map<string,string>"

    def __init__(self, emit: Callable[[dict], None] | None = None):
        self.rows, self._open, self.emit = [], [], emit

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """What is put into the mapping within the span is an attribute as well."""
        row = {"name": name, "parent": self._open[-1] if self._open else None, "start": time.time(), "status": "ok"}
        own = {k: str(v) for k, v in attributes.items()}
        self._open.append(name)
        try:
            yield own
        except Exception as error:
            row["status"] = f"error: {error}"
            raise
        finally:
            self._open.pop()
            self.rows.append(row | {"stop": time.time(), "attributes": {k: str(v) for k, v in own.items()}})
            if self.emit:
                self.emit(self.rows[-1])

    def table(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], self.SCHEMA)


@dataclass
class Suite:
    """folder: where snapshots are, shared by all executors."""

    spark: SparkSession
    folder: str
    spans: Spans = field(default_factory=Spans)

    def save(self, segments: DataFrame, model: str, at: str, tags: dict[str, str] | None = None) -> None:
        with self.spans.span("save", model=model, at=at):
            store.save(segments, self.folder, model, at, tags)

    def load(self, snapshot_id: str) -> DataFrame:
        return store.load(self.spark, self.folder, snapshot_id)

    def search(self, tags: dict[str, str] | None = None, model: str | None = None, most: int | None = 100) -> DataFrame:
        return store.search(self.spark, self.folder, tags, model, most)

    def diff(self, old: str, new: str) -> DataFrame:
        return inspect.diff_segments(self.load(old), self.load(new))

    def golden(self, expected: str, actual: str) -> DataFrame:
        return inspect.same_as_snapshot(self.load(expected), self.load(actual))

    def metrics(self, points: DataFrame) -> DataFrame:
        return inspect.summary(points, ["name"])
