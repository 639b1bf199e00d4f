"""Quality by regularised quadratic discriminant analysis.

A text becomes DIMS statistics of its words and characters, transformed to lie near a normal shape.  Per class the
count, sum and outer-product sum of all labelled rows are added up where the rows are; the driver gets these moments
only.  Covariances shrink towards the pooled one (ALPHA) and that towards its diagonal (GAMMA); a class's Cholesky
factor is kept, and a text's score is the logistic of the difference of its two log densities, priors included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import held_out, stage, table
from ctxloom.llm.wordhash import slices, text_buffer, word_bounds, word_hashes

ALPHA, GAMMA = 0.1, 0.05
#: Scale of the log-density difference before the logistic; densities of correlated statistics are overconfident.
HEAT = 4.0
#: Folds of labelled ids, and the one kept from learning.
FOLDS, HELD = 3, 1

_KINDS = {
    "upper": range(65, 91), "lower": [*range(97, 123), *range(128, 256)], "digit": range(48, 58),
    "stop": [ord(c) for c in ".,;:?"], "symbol": [ord(c) for c in "#$%&*!@^~<>=+_{}[]\\/"], "pipe": [ord("|")], "line": [10],
}
_TABLE = np.zeros((256, len(_KINDS)), np.float64)
for _i, _codes in enumerate(_KINDS.values()):
    _TABLE[list(_codes), _i] = 1
NAMES = [*_KINDS, "words", "word_length", "word_spread", "distinct", "repeated", "capital", "line_words", "lone"]
DIMS = len(NAMES)


def _of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = int(offsets[0])
    part, at = data[low : int(offsets[-1])], offsets - low
    size = np.diff(at)
    starts, ends, first = word_bounds(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(size), DIMS))

    def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
        return sums[bounds[1:]] - sums[bounds[:-1]]

    kinds = {k: per_text(_TABLE[part, i], at) for i, k in enumerate(_KINDS)}
    letters = np.maximum(kinds["upper"] + kinds["lower"], 1)
    some, words = np.maximum(size, 1), np.maximum(n, 1)
    out[:, 0] = np.sqrt(kinds["upper"] / letters)
    for i, k in enumerate(list(_KINDS)[1:], 1):
        out[:, i] = np.sqrt(kinds[k] / (words if k != "lower" else some))
    length = (ends - starts).astype(np.float64)
    mean = per_text(length, first) / words
    out[:, 7] = np.log1p(n)
    out[:, 8] = np.log1p(mean)
    out[:, 9] = np.sqrt(np.maximum(per_text(length**2, first) / words - mean**2, 0)) / (1 + mean)
    hashes = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
    out[:, 10] = np.bincount(o[new], minlength=len(n)) / np.maximum(n, 1) ** 0.85
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])][: len(h)]
    out[:, 11] = np.sqrt(np.bincount(owner[same], minlength=len(n)) / words)
    initial = data[starts] if len(starts) else np.zeros(0, np.uint8)
    out[:, 12] = np.sqrt(np.bincount(owner[(initial >= 65) & (initial <= 90)], minlength=len(n)) / words)
    out[:, 13] = np.log1p(n / (1 + kinds["line"]))
    out[:, 14] = np.sqrt(np.bincount(owner[length == 1], minlength=len(n)) / words)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, DIMS); null counts as empty."""
    data, offsets = text_buffer(column)
    return np.concatenate([_of(data, offsets[i : j + 1]) for i, j in slices(offsets)] or [np.zeros((0, DIMS))])


def forward(root: np.ndarray, z: np.ndarray) -> np.ndarray:
    """root^-1 z for a lower triangular root, row by row."""
    out = np.empty_like(z)
    for i in range(len(root)):
        out[i] = (z[i] - root[i, :i] @ out[:i]) / root[i, i]
    return out


class Model:
    """Per class the mean, the Cholesky factor of the inverse's covariance and the constant of the log density."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(m[0] for m in moments.values())
        self.rate = moments.get(1, (0.0,))[0] / total if total else 0.5
        self.classes = {}
        if len(moments) < 2:
            return
        scatter = {k: second - np.outer(first, first) / n for k, (n, first, second) in moments.items()}
        pooled = sum(scatter.values()) / total + 1e-6 * np.eye(DIMS)
        pooled = (1 - GAMMA) * pooled + GAMMA * np.diag(np.diag(pooled))
        for k, (n, first, _) in moments.items():
            root = np.linalg.cholesky((1 - ALPHA) * scatter[k] / n + ALPHA * pooled)
            self.classes[k] = (first / n, root, np.log(n / total) - np.log(np.diag(root)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.rate)
        density = {}
        for k, (mean, root, constant) in self.classes.items():
            density[k] = constant - (forward(root, (x - mean).T) ** 2).sum(axis=0) / 2
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / HEAT, -40, 40)))


def moments_of(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """labelled: (stats array<double>, quality).  One row per class and task reaches the driver."""

    def add(frames):
        found = {}
        for pdf in frames:
            for k, group in pdf.groupby("quality"):
                x = np.stack(group["stats"].to_numpy())
                n, first, second = found.get(k, (0.0, np.zeros(DIMS), np.zeros((DIMS, DIMS))))
                found[k] = (n + len(x), first + x.sum(axis=0), second + x.T @ x)
        yield pd.DataFrame([{"quality": k, "n": n, "sums": [*first, *second.ravel()]} for k, (n, first, second) in found.items()], columns=["quality", "n", "sums"])

    parts = labelled.mapInPandas(add, "quality int, n double, sums array<double>")
    summed = parts.select("quality", "n", F.posexplode("sums").alias("at", "value")).groupBy("quality", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("quality", "at").collect()
    out = {}
    for k in {r["quality"] for r in summed}:
        values = np.array([r["value"] for r in summed if r["quality"] == k])
        out[int(k)] = (next(r["n"] for r in summed if r["quality"] == k), values[:DIMS], values[DIMS:].reshape(DIMS, DIMS))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs, which has no column stats, with that column."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(pa.array(texts, pa.large_string(), from_pandas=True))))

    return docs.withColumn("stats", stats("text"))


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """rows: (doc_id, stats).  Labels other than 0 and 1, null ids and the held-out fold teach nothing; an id labelled
    or present several times counts each time."""
    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int")).filter(~held_out("doc_id", FOLDS, HELD))
    return Model(moments_of(rows.join(known, "doc_id").select("stats", "quality")))


def score_column(model: Model, stats: str = "stats"):
    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_numpy())) if len(values) else np.zeros(0))

    return score(stats)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Statistics of null and empty texts are all 0 and are scored as any other; a long text is taken whole.  Rows that
    repeat an id are scored each, by their texts.  Without labels of both classes the score is the share of label 1, or
    0.5.  No rows: no rows."""
    rows = stage(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "quality")
    model = learn(rows, labels)
    return rows.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever their names; texts are scored as in
    classify().  No rows: no rows."""
    rows = stage(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "quality")
    model = learn(rows, labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(pa.array(texts, pa.large_string(), from_pandas=True))) >= 0.5)

    return docs.filter(good("text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
