"""The whole assembly: normalise, sanitise, rerank, allocate, compress, order; one audit row for every decision."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.operators import assemble, budget, compress, rerank
from ctxloom.operators import sanitize as chains
from ctxloom.sources.shared import written

AUDIT = ("request_id", "segment_id", "stage", "decision", "reason", "tokens", "ratio")


def audit(df: DataFrame, stage: str, decision, reason, tokens="token_count", ratio=None) -> DataFrame:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    ratio = F.lit(None) if ratio is None else ratio
    return df.select("request_id", "segment_id", F.lit(stage).alias("stage"), column(decision).alias("decision"), column(reason).alias("reason"), tokens.cast("long").alias("tokens"), ratio.cast("double").alias("ratio"))


def _diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("request_id", "segment_id"), ["request_id", "segment_id"], "left_anti")


class StageError(RuntimeError):
    """A stage failed; its cause is the error's."""


@dataclass(frozen=True)
class Settings:
    policy: budget.Policy = budget.Policy()
    current_turn: int = 0
    namespace: str = "default"
    #: Sanitizers; None is pipeline_chain() with the settings below.
    chain: tuple[chains.Sanitizer, ...] | None = None
    strip_html: bool = True
    #: Kinds of personal data to mask; None masks nothing, an empty tuple all.
    masks: tuple[str, ...] | None = None
    detects: bool = True
    on_injection: str = "warn_and_remove"
    level: str = "heuristic"
    most_chars: int = 50_000
    #: Decay of scores with age in turns, or None; least weight.
    decay: float | None = None
    least_weight: float = 0.3
    most_per_type: int | None = None
    diversity: bool = False
    relevance: float = 0.7
    similarity: float = 0.85
    compress: bool = True
    compress_at: float = 0.85
    least_tokens: int = 50
    #: What a request still over its budget after compression is: an "error", or one to "keep" with an audit row.
    on_over: str = "keep"
    merge: bool = False


Stage = Callable[[DataFrame, Settings], tuple[DataFrame, list[DataFrame]]]


def normalise(df: DataFrame, settings: Settings):
    clean = T.strip_invisible(T.nfc(F.col("content")))
    out = df.withColumn("raw", F.col("content")).withColumn("content", clean)
    changed, blank = out.filter("raw <> content"), out.filter(T.is_blank(F.col("content")))
    kept = out.filter(~T.is_blank(F.col("content"))).drop("raw").withColumn("token_count", T.token_count(F.col("content")))
    return kept, [audit(changed, "normalize", "sanitize", "unicode_normalized"), audit(blank, "normalize", "drop", "blank")]


def sanitise(df: DataFrame, settings: Settings):
    chain = list(settings.chain) if settings.chain is not None else chains.pipeline_chain(settings.strip_html, settings.masks, settings.detects, settings.on_injection, settings.level, settings.most_chars)
    # Written, as the rows that pass and the audit would clean every text anew.
    cleaned = chains.chain(df.withColumn("raw", F.col("content")), chain, quiet=True).withColumn("changed", F.col("raw") != F.col("content"))
    out = written(cleaned.drop("raw"))
    kept = out.filter("passed").withColumn("token_count", T.token_count(F.col("content")))
    reason = F.when(F.col("refused_by") == "InjectionDetector", "injection").when(F.col("refused_by") == "LengthGuard", "length").otherwise("sanitize_failed")
    audits = [audit(out.filter("passed and changed"), "sanitize", "sanitize", "cleaned"), audit(out.filter("not passed"), "sanitize", "drop", reason)]
    return kept.drop("changed", "passed", "refused_by", "warning"), audits


def choose(df: DataFrame, settings: Settings):
    live = rerank.drop_expired(df, settings.current_turn)
    seen = rerank.drop_hidden(live, settings.namespace)
    single = rerank.drop_copies(seen)
    audits = [audit(_diff(df, live), "rerank", "drop", "expired"), audit(_diff(live, seen), "rerank", "drop", "hidden"), audit(_diff(seen, single), "rerank", "drop", "copy")]
    out = single if settings.decay is None else rerank.decay(single, settings.current_turn, settings.decay, settings.least_weight)
    if settings.diversity:
        single = out
        out = rerank.diversify(single, settings.relevance, settings.similarity)
        audits.append(audit(_diff(single, out), "rerank", "drop", "similar"))
    if settings.most_per_type is not None:
        capped = rerank.cap_types(out, settings.most_per_type)
        audits.append(audit(_diff(out, capped), "rerank", "drop", "cap"))
        out = capped
    return rerank.order(out), audits


def fit(df: DataFrame, settings: Settings):
    kept, decisions = budget.allocate(df, settings.policy)
    return kept, [audit(decisions.filter("decision in ('drop', 'truncate')"), "allocate", F.col("decision"), "budget_exceeded", "tokens")]


def shrink(df: DataFrame, settings: Settings):
    """The cascade, where compression is on; a request whose tokens changed has one row, of its first segment."""
    if not settings.compress:
        return df, []
    available = settings.policy.available
    out = compress.cascade(df, available, settings.compress_at, settings.least_tokens, settings.on_over)
    first = F.min_by("segment_id", "pos").alias("segment_id")
    before = df.groupBy("request_id").agg(first, F.sum("token_count").alias("before"))
    after = out.groupBy("request_id").agg(F.sum("token_count").alias("after"))
    both = before.join(after, "request_id", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    rows = audit(both.filter("before <> after"), "compress", "compress", "window_saturation", F.col("after") - F.col("before"), compress.ratio(F.col("before"), F.col("after")))
    over = both.filter((F.col("after") > available) & (F.col("before") / available >= settings.compress_at)) if available else both.limit(0)
    return out.drop("cut"), [rows, audit(over, "compress", "keep_over", "compression_failed", F.col("after"))]


def arrange(df: DataFrame, settings: Settings):
    out = assemble.order(df)
    return out, [audit(out, "assemble", "keep", "budget_exceeded")]


STAGES: tuple[tuple[str, Stage], ...] = (("normalize", normalise), ("sanitize", sanitise), ("rerank", choose), ("allocate", fit), ("compress", shrink), ("assemble", arrange))
#: Stages that read their rows' texts several times: these are written first.
REREAD = ("compress",)


def inserted(name: str, stage: Stage, before: str | None = None, stages=STAGES) -> tuple[tuple[str, Stage], ...]:
    """stages with one more, before the named one or last."""
    at = len(stages) if before is None else [n for n, _ in stages].index(before)
    return (*stages[:at], (name, stage), *stages[at:])


def replaced(name: str, stage: Stage, stages=STAGES) -> tuple[tuple[str, Stage], ...]:
    if name not in [n for n, _ in stages]:
        raise KeyError(name)
    return tuple((n, stage if n == name else s) for n, s in stages)


def removed(name: str, stages=STAGES) -> tuple[tuple[str, Stage], ...]:
    return tuple((n, s) for n, s in stages if n != name)


@dataclass(frozen=True)
class Package:
    """What a build gives: assembled segments, audit rows, and the allocation by request and type where the stage ran,
    which is planned when it is asked for."""

    segments: DataFrame
    audit: DataFrame
    allocated: Callable[[], DataFrame] | None

    @property
    def allocation(self) -> DataFrame | None:
        return self.allocated() if self.allocated else None


def _allocation(df: DataFrame, policy: budget.Policy) -> DataFrame:
    return budget.allocation(budget.allocate(df, policy)[1], policy)


def build(segments: DataFrame, settings: Settings = Settings(), stages=STAGES, skip: tuple[str, ...] = (), write: bool = False, spans=None) -> Package:
    """Stages may be replaced, added or skipped by name.  What a stage named in REREAD takes is written to the shared
    folder and read again; with write every stage's rows are, which is worth it where the audit is wanted, as its rows
    would otherwise compute each stage once more.

    spans (see suite.Spans) gets a span for the build and each stage; of written stages with rows and tokens, observed as
    they are written."""
    rows: list[DataFrame] = []
    allocation = None
    with spans.span("build", stages=",".join(n for n, _ in stages)) if spans else nullcontext({}):
        out = written(segments) if write else segments
        for name, stage in stages:
            if name in skip or name == "compress" and not settings.compress and stage is shrink:
                continue
            with spans.span(name) if spans else nullcontext({}) as noted:
                if name in REREAD and not write:
                    out = written(out)
                if name == "allocate" and stage is fit:
                    allocation = partial(_allocation, out, settings.policy)
                try:
                    out, found = stage(out, settings)
                    out = _observed(out, noted) if write else out
                except (budget.BudgetError, compress.CompressionError):
                    raise
                except Exception as error:
                    raise StageError(f"stage {name}: {error}") from error
            rows += found
    whole = None
    for more in rows:
        whole = more if whole is None else whole.unionByName(more)
    if whole is None:
        whole = audit(out.limit(0), "", "", "")
    return Package(assemble.merge_adjacent(out) if settings.merge else out, whole, allocation)


def _observed(df: DataFrame, noted: dict) -> DataFrame:
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")))
    noted.update(seen.get)
    return out


def run(segments: DataFrame, settings: Settings = Settings(), stages=STAGES, skip: tuple[str, ...] = (), write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assembled segments, audit) of build()."""
    package = build(segments, settings, stages, skip, write)
    return package.segments, package.audit


def build_cached(segments: DataFrame, keys: DataFrame, cache: DataFrame, now, settings: Settings = Settings(), **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assembled segments, entries to add, lookups): requests whose key (keys: request_id, key) has a live entry in
    cache (see inspect.lookup) take their segments from it and go through no stage; an entry that doesn't read back is a
    miss.  An entry's value is the JSON of its segments."""
    from ctxloom.operators import inspect

    schema = "array<struct<pos:int,segment_id:string,type:string,role:string,content:string,token_count:int>>"
    looked = inspect.lookup(keys, cache, now).withColumn("held", F.from_json("value", schema))
    looked = written(looked.withColumn("hit", F.col("hit") & F.coalesce(F.size("held") > 0, F.lit(False)) & F.coalesce(F.forall("held", lambda s: s["segment_id"].isNotNull()), F.lit(False))))
    hits = looked.filter("hit").select("request_id", F.explode("held").alias("s")).select("request_id", "s.*")
    misses = segments.join(looked.filter("not hit").select("request_id"), "request_id", "left_semi")
    fields = ["pos", "segment_id", "type", "role", "content", "token_count"]
    built = written(run(misses, replace(settings, merge=False), **more)[0].select("request_id", *fields))
    value = F.to_json(F.array_sort(F.collect_list(F.struct(*fields))))
    entries = built.groupBy("request_id").agg(value.alias("value")).join(keys, "request_id").select("key", "value")
    return built.unionByName(hits), entries, looked.select("request_id", "key", "hit")
