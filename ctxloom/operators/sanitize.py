"""Chains of sanitizers over a text column: each changes the text, may refuse it, and may warn.

After a refusal the rest of a chain leaves the row alone.  Everything is a column expression, so a chain is a projection;
a sanitizer written in Python runs on Arrow batches, and where it raises the row is refused as failed."""

from __future__ import annotations

import warnings as python_warnings
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import text as T


@dataclass(frozen=True)
class Sanitizer:
    """apply: text to text, or to a struct with text content and more fields.  finding, of (before, applied), is what it
    has to say, or null; with blocks a row with a finding is refused."""

    name: str
    apply: Callable[[Column], Column]
    finding: Callable[[Column, Column], Column] | None = None
    blocks: bool = False
    struct: bool = False


def _listed(label: str, found: Column) -> Column:
    return F.concat(F.lit(label), F.nullif(F.array_join(found, ","), F.lit("")))


def unicode(form: str = "NFC", control: bool = True, zero_width: bool = True) -> Sanitizer:
    return Sanitizer("UnicodeNormalizer", lambda c: T.normalise_unicode(c, form, control, zero_width))


def html(mode: str = "strip", spaced: bool = True) -> Sanitizer:
    if mode not in ("strip", "escape"):
        raise ValueError(f"unknown mode {mode}")
    return Sanitizer("HTMLStripper", T.escape_html if mode == "escape" else lambda c: T.strip_html(c, spaced))


def markdown(keep_code: bool = True) -> Sanitizer:
    return Sanitizer("MarkdownStripper", lambda c: T.strip_markdown(c, keep_code))


def personal(kinds: tuple[str, ...] = (), mark: str = "*") -> Sanitizer:
    """Unknown kinds are left out, with a warning; none left means all."""
    unknown = [k for k in kinds if k not in T.MASKED]
    if unknown:
        python_warnings.warn(f"unknown kinds of personal data: {', '.join(unknown)}", stacklevel=2)
    own = tuple(k for k in kinds if k in T.MASKED) or tuple(T.MASKED)

    def finding(before: Column, after: Column) -> Column:
        return _listed("masked ", F.transform(F.array_sort(F.map_entries(after["counts"])), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))

    return Sanitizer("PIIRedactor", lambda c: T.redact(c, own, mark), finding, struct=True)


def injection(level: str = "standard", block: bool = True) -> Sanitizer:
    return Sanitizer("InjectionDetector", lambda c: c, lambda before, after: _listed("injection: ", T.injection_hits(before, level)), block)


def length(chars: int = 100_000, lines: int = 10_000, line: int = 10_000, repeated: float | None = 0.8, cut: bool = False) -> Sanitizer:
    """Refuses what is over a limit, or cuts it."""
    if min(chars, lines, line) <= 0 or repeated is not None and not 0 <= repeated <= 1:
        raise ValueError("limits must be above 0, the share of repetition between 0 and 1")
    apply = (lambda c: T.truncate(c, chars, lines, line)) if cut else (lambda c: c)
    return Sanitizer("LengthGuard", apply, lambda before, after: _listed("over limits: ", T.length_checks(before, chars, lines, line, repeated)), not cut)


def of_function(name: str, function: Callable[[str], str]) -> Sanitizer:
    """A Python function of one text; a text for which it raises is refused."""

    @F.pandas_udf("content string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                rows.append((None if value is None else function(value), None))
            except Exception as error:  # the row's own failure
                rows.append((value, f"failed: {error}"))
        return pd.DataFrame(rows, columns=["content", "error"])

    return Sanitizer(name, run, lambda before, after: after["error"], True, struct=True)


def chain(df: DataFrame, sanitizers: list[Sanitizer], column: str = "content", quiet: bool = False) -> DataFrame:
    """df with the column sanitized, passed, refused_by (a sanitizer's name), and warning: all findings, each behind its
    sanitizer's name, of a refused row the refusing one's alone.  quiet leaves the findings of sanitizers that refuse
    nothing out, which saves looking for them.  An empty chain passes everything."""
    if not sanitizers:
        python_warnings.warn("an empty chain passes everything", stacklevel=2)
    applied, found, warned = "__applied", "__found", "__warnings"
    out = df.withColumns({"refused_by": F.lit(None).cast("string"), warned: F.array().cast("array<string>")})
    for s in sanitizers:
        before, going = F.col(column), F.col("refused_by").isNull()
        looks = s.finding is not None and (s.blocks or not quiet)
        out = out.withColumn(applied, s.apply(before))
        after = F.col(applied)
        if looks:
            out = out.withColumn(found, F.when(going, s.finding(before, after)))
            named = F.array_compact(F.array(F.concat(F.lit(f"[{s.name}] "), found)))
            notes = F.when(F.col(found).isNull(), F.col(warned)).otherwise(named if s.blocks else F.concat(warned, named))
        text = after["content"] if s.struct else after
        changed = {column: F.when(going, text).otherwise(before)}
        if looks:
            changed |= {warned: notes} | ({"refused_by": F.when(F.col(found).isNotNull(), s.name).otherwise(F.col("refused_by"))} if s.blocks else {})
        out = out.withColumns(changed).drop(applied, found)
    return out.withColumns({"passed": F.col("refused_by").isNull(), "warning": F.when(F.size(warned) > 0, F.array_join(warned, "; "))}).drop(warned)


def standalone_chain(masks: bool = True, detects: bool = True, level: str = "standard", chars: int = 100_000) -> list[Sanitizer]:
    """Refuses long and repetitive texts before anything else is done with them."""
    out = [unicode(), length(chars), html()]
    out += [personal()] if masks else []
    return out + ([injection(level, True)] if detects else [])


def pipeline_chain(strip_html: bool = True, kinds: tuple[str, ...] | None = None, detects: bool = True, on_injection: str = "warn_and_remove", level: str = "heuristic", chars: int = 50_000) -> list[Sanitizer]:
    """What the pipeline runs: lengths come last and are cut.  kinds None masks nothing.  Injections are refused unless
    only logged; a classifier isn't there, so that level is the heuristic one."""
    names = {"heuristic": "standard", "classifier": "standard"}
    out = [unicode()] + ([html()] if strip_html else []) + ([personal(kinds)] if kinds is not None else [])
    out += [injection(names.get(level, level), on_injection in ("warn_and_remove", "error"))] if detects else []
    return [*out, length(chars, cut=True)]
