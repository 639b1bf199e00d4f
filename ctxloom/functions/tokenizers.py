"""Token counters: by characters, or by a byte-pair vocabulary file, and which one a model has.

A counter turns a text column into a count; a vocabulary is read once by each Python worker, from a path that all
executors see."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import text as T

# A message's and a reply's own tokens; encodings by the beginnings of models' names; the pattern by which
# byte-level encodings split a text.
MESSAGE, REPLY, NAME = 4, 3, -1
ENCODINGS = {
    "gpt-4o": "o200k_base", "gpt-4o-mini": "o200k_base", "chatgpt-4o": "o200k_base", "gpt-4-turbo": "cl100k_base", "gpt-4-": "cl100k_base", "gpt-4": "cl100k_base", "gpt-3.5": "cl100k_base",
    "o1": "o200k_base", "o3": "o200k_base", "o4-mini": "o200k_base", "claude": "cl100k_base", "gemini": "cl100k_base", "llama": "cl100k_base", "mistral": "cl100k_base", "qwen": "cl100k_base", "deepseek": "cl100k_base",
}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@runtime_checkable
class Counter(Protocol):
    name: str

    def count(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class Characters:
    """Estimates by characters, all in the JVM; a fixed number of characters for a token, if given."""

    chars_per_token: float | None = None
    name: str = "char_based"

    def count(self, text: Column) -> Column:
        return T.token_count(text, self.chars_per_token)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """A vocabulary of ranks: a line is a token in base 64 and its rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class BytePairs:
    path: str
    pattern: str = PATTERN
    name: str = "byte_pairs"

    def _map(self, of, kind: str):
        path, pattern = self.path, self.pattern

        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = encoding(path, pattern)
            for values in parts:
                yield values.map(lambda v: of(held, v), na_action="ignore")

        return run

    def count(self, text: Column) -> Column:
        return F.coalesce(self._map(lambda held, v: len(held.encode_ordinary(v)), "int")(text), F.lit(0))

    def encode(self, text: Column) -> Column:
        return self._map(lambda held, v: held.encode_ordinary(v), "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        return self._map(lambda held, v: held.decode([int(i) for i in v]), "string")(ids)

    def truncate(self, text: Column, most: int) -> Column:
        """The text of its first `most` tokens; none or fewer: the empty text."""
        if most <= 0:
            return F.when(text.isNotNull(), "")
        return self._map(lambda held, v: held.decode(ids[:most]) if len(ids := held.encode_ordinary(v)) > most else v, "string")(text)


def count_messages(df: DataFrame, by: str, columns: list[str], counter: Counter = Characters()) -> DataFrame:
    """(by, tokens): of a group's messages, all columns' texts, each message's own tokens and the reply's; a column called
    name takes one off, where there is one."""
    each = F.lit(MESSAGE)
    for c in columns:
        own = F.coalesce(counter.count(F.col(c)), F.lit(0)) + (NAME if c == "name" else 0)
        each = each + F.when(F.col(c).isNotNull(), own).otherwise(0)
    return df.withColumn("__tokens", each).groupBy(by).agg((F.sum("__tokens") + REPLY).alias("tokens"))


def encoding_of(model: str) -> str | None:
    """By the longest beginning of the model's name."""
    low = model.lower()
    return next((ENCODINGS[p] for p in sorted(ENCODINGS, key=len, reverse=True) if low.startswith(p)), None)


class Registry:
    """Which counter a model has: its own registered one, else that of its encoding where files has the encoding's
    vocabulary, else characters.  Answers are remembered."""

    def __init__(self, files: dict[str, str] | None = None):
        self.files, self._own, self._known = dict(files or {}), {}, {}

    def register(self, model: str, counter: Counter) -> None:
        if not isinstance(counter, Counter):
            raise TypeError(f"{type(counter).__name__} has no name or no count()")
        self._own[model] = counter

    def clear(self) -> None:
        """Forgets what was resolved; registered counters stay."""
        self._known.clear()

    def resolve(self, model: str) -> Counter:
        if model in self._own:
            return self._own[model]
        if model not in self._known:
            kind = encoding_of(model)
            self._known[model] = BytePairs(self.files[kind], name=f"tiktoken:{kind}") if kind in self.files else Characters()
        return self._known[model]
