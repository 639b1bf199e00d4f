"""Personal data by weak supervision.

Base spans follow four fixed patterns and always stay.  Besides them, candidates (loose forms of the same kinds, and
secrets after a naming word) get votes of labelers: checks of form, gazetteers of words and of domain endings, context
around the span and variety within it; each says personal, not, or nothing.  Over the histogram of vote patterns of all
documents, expectation-maximisation estimates each labeler's reliability and each pattern's probability; these train
the final span classifier, a logistic regression over kind, votes and shape.  Candidates it accepts that overlap no
base span are added.

Only the histogram reaches the driver: one row for each (kind, votes, shape) seen, a few thousand at most by its
construction, at any size of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import stage, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers.
NAMING = ("mail", "email", "e-mail", "contact", "phone", "tel", "mobile", "call", "fax", "card", "visa", "credit", "iban", "ip", "host", "server", "token", "key", "secret", "password", "passwd")
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at | ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]++(?:(?: dot | ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)++", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_LONG = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])")
_SECRET = re.compile(r"(?i)(?<![A-Za-z])(?:token|key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+=-]{8,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, leftmost and non-overlapping per kind, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            done = found.end()
            out.append((low, 0, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts, low = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((low, 1, low + size))
                low += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0] if c < "\x7f") <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Loose spans (start, kind, end), base ones included."""
    out = base_spans(text)
    if re.search("dot", text, re.IGNORECASE):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 2, m.end()) for m in _LONG.finditer(text)]
        out += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    return sorted(set(out))


def votes(text: str, start: int, kind: int, end: int, base: bool) -> str:
    """One letter per labeler (y, n or -), then the shape."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    form = {0: "y" if base else "-", 1: "y" if base else "n", 2: "y" if luhn(digits) else "n", 3: "y" if 9 <= len(digits) <= 15 else "n", 4: "y" if re.search(r"[0-9]", span) and re.search(r"[A-Za-z]", span) else "n"}[kind]
    before = re.findall(r"[A-Za-z-]+", text[max(0, start - 24) : start].lower())
    words = "y" if any(w in NAMING for w in before) else "-"
    ending = ("y" if re.split(r"[^A-Za-z]+", span.lower().rstrip())[-1] in ENDINGS else "n") if kind == 0 else "-"
    left, right = text[start - 1 : start], text[end : end + 1]
    apart = "y" if not (left.isalnum() or right.isalnum() or left in "#$%&*" and left or right in "_@" and right) else "n"
    alphabet = re.sub(r"[^0-9A-Za-z]", "", span)
    varied = "y" if len(set(alphabet)) >= min(5, max(2, len(alphabet) // 3)) else "n"
    shape = f"{min(len(digits) // 4, 5)}{'s' if re.search(r'[ ().-]', span) else 'j'}"
    return form + words + ending + apart + varied + shape


LABELERS = 5


def estimate(patterns: dict[tuple[int, str], int], rounds: int = 50) -> dict[tuple[int, str], float]:
    """EM of a naive mixture of two classes over vote patterns: the probability that a pattern is personal."""
    keys = list(patterns)
    count = np.array([patterns[k] for k in keys], float)
    said = np.array([[{"y": 1, "n": 0, "-": -1}[c] for c in key[:LABELERS]] for _, key in keys])
    kind = np.array([k for k, _ in keys])
    yes, no = (said == 1).sum(axis=1), (said == 0).sum(axis=1)
    p = (yes + 1) / (yes + no + 2)
    for _ in range(rounds):
        prior = np.array([((count * p)[kind == k].sum() + 2) / (count[kind == k].sum() + 4) for k in range(len(KINDS))])
        logit = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(LABELERS):
            for v in (0, 1):
                hit = said[:, j] == v
                # A labeler is taken to be right rather than wrong before any evidence.
                own = ((count * p * hit).sum() + (4 if v else 1)) / ((count * p * (said[:, j] >= 0)).sum() + 5)
                other = ((count * (1 - p) * hit).sum() + (1 if v else 4)) / ((count * (1 - p) * (said[:, j] >= 0)).sum() + 5)
                logit[hit] += np.log(own / other)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys, p.tolist()))


def _features(keys) -> np.ndarray:
    shapes = sorted({c for c in "012345"})
    rows = []
    for kind, key in keys:
        row = [1.0] + [float(kind == k) for k in range(len(KINDS))]
        for c in key[:LABELERS]:
            row += [float(c == "y"), float(c == "n")]
        row += [float(key[LABELERS] == s) for s in shapes] + [float(key[LABELERS + 1] == "s")]
        rows.append(row)
    return np.array(rows)


def train(patterns: dict[tuple[int, str], int], ridge: float = 1.0, rounds: int = 30) -> dict[tuple[int, str], float]:
    """The span classifier's probability for each pattern; fitted to EM's by Newton steps, weighted by the counts' roots."""
    if not patterns:
        return {}
    target = estimate(patterns)
    keys = list(patterns)
    x, y = _features(keys), np.array([target[k] for k in keys])
    weight = np.sqrt(np.array([patterns[k] for k in keys], float))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


FOUND = "doc_id long, base array<struct<start:int,kind:int,stop:int>>, more array<struct<start:int,kind:int,stop:int,key:string>>"


def extract(docs: DataFrame) -> DataFrame:
    """Per row its base spans, and all its candidates with their votes."""

    def run(batches):
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
        voted = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("key", pa.string())])
        for batch in batches:
            base, more = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append([{"start": s, "kind": k, "stop": e} for s, k, e in own])
                known = set(own)
                more.append([{"start": s, "kind": k, "stop": e, "key": votes(text, s, k, e, (s, k, e) in known)} for s, k, e in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(voted))], names=["doc_id", "base", "more"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def learn(found: DataFrame) -> dict[tuple[int, str], float]:
    rows = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.key").agg(F.count("*").alias("n")).collect()
    return train({(r["kind"], r["key"]): r["n"] for r in sorted(rows, key=lambda r: (r["kind"], r["key"]))})


def all_spans(base: list[tuple], more: list[tuple], model: dict) -> list[tuple[int, int, int]]:
    """Base spans and those accepted, in order of more, that overlap none of the spans so far; all are given in order."""
    starts, ends = [], []  # of the base spans, overlapping ones made one
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out, last = list(base), 0
    for s, k, e, key in more:
        if s >= last and model.get((k, key), 0.0) >= 0.5:
            at = bisect_right(ends, s)
            if at == len(ends) or starts[at] >= e:
                out.append((s, k, e))
                last = e
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs, repeated ids and rows too; offsets in code points, ends exclusive.  Null and empty texts
    have no spans; long ones are taken whole, in time linear in their length.  Without any candidate in docs nothing is
    learned and nothing added.  n_spans counts all spans, added ones too.  No rows: no rows."""
    found = stage(extract(docs), "personal")
    model = learn(found)

    def run(batches):
        for batch in batches:
            ids, bases, mores = (c.to_pylist() for c in batch.columns)
            rows = []
            for doc_id, base, more in zip(ids, bases, mores):
                own = [(x["start"], x["kind"], x["stop"]) for x in base]
                spans = all_spans(own, [(x["start"], x["kind"], x["stop"], x["key"]) for x in more], model) if more else own
                rows.append({"doc_id": doc_id} | {f"n_{k}": sum(x[1] == i for x in own) for i, k in enumerate(KINDS[:BASE])} | {"base_sha256": hashlib.sha256(spelled(own).encode()).hexdigest(), "spans": spelled(spans), "n_spans": len(spans)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in RESULT.split(", "))]))

    return found.mapInArrow(run, RESULT)


def redact(docs: DataFrame, mask: str = "<{}>") -> DataFrame:
    """docs, with all its columns whatever their names, every span of its text replaced by its kind's mask, and n_chars
    following the text where there is such a column.  Null texts stay null; no rows: no rows."""
    model = learn(stage(extract(docs), "personal"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def of(text):
            if text is None:
                return None
            base = base_spans(text)
            known, out = set(base), text
            more = candidates(text)
            if not more:
                return text
            spans = all_spans(base, [(s, k, e, votes(text, s, k, e, (s, k, e) in known)) for s, k, e in more], model)
            parts, at = [], 0
            for s, k, e in spans:
                if s >= at:
                    parts += [text[at:s], mask.format(KINDS[k])]
                elif e <= at:
                    continue
                at = max(at, e)
            out = "".join(parts) + text[at:]
            return out

        return texts.map(of, na_action="ignore")

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
