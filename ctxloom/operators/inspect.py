"""Looking at built requests: differences, golden checks, metrics, lint, agents' views, cached keys.

Segments and audits are plain DataFrames; findings come as rows."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.operators.rerank import REQUEST, visible_to
from ctxloom.sources.shared import written

CHANGES = ("added", "removed", "modified", "reordered", "budget", "metadata")


# --- differences ---


def diff_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """(segment_id, change, old_value, new_value); a segment may be both modified and reordered."""
    a = old.select("segment_id", F.col("content").alias("ca"), F.col("pos").alias("pa"))
    b = new.select("segment_id", F.col("content").alias("cb"), F.col("pos").alias("pb"))
    both = a.join(b, "segment_id", "full")
    first = lambda c: F.substring(c, 1, 100)
    rows = F.array_compact(F.array(
        F.when(F.col("pa").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_value"), first("cb").alias("new_value"))),
        F.when(F.col("pb").isNull(), F.struct(F.lit("removed").alias("change"), first("ca").alias("old_value"), F.lit(None).cast("string").alias("new_value"))),
        F.when(F.col("ca") != F.col("cb"), F.struct(F.lit("modified").alias("change"), first("ca").alias("old_value"), first("cb").alias("new_value"))),
        F.when(F.col("pa") != F.col("pb"), F.struct(F.lit("reordered").alias("change"), F.col("pa").cast("string").alias("old_value"), F.col("pb").cast("string").alias("new_value"))),
    ))
    return both.select("segment_id", F.explode(rows).alias("d")).select("segment_id", "d.*")


def diff_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of the fields that differ."""
    a, b = (df.select(key, *[F.col(f).cast("string").alias(f"{f}_{s}") for f in fields]) for df, s in ((old, "old"), (new, "new")))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old_value"), F.col(f"{f}_new").alias("new_value")) for f in fields])
    return a.join(b, key).select(key, F.explode(rows).alias("d")).select(key, "d.*").filter("not old_value <=> new_value")


def diff_summary(changes: DataFrame) -> DataFrame:
    kinds = changes.sparkSession.createDataFrame([(c,) for c in CHANGES], "change string")
    return kinds.join(changes.groupBy("change").agg(F.count("*").alias("n")), "change", "left").select("change", F.coalesce("n", F.lit(0)).alias("n"))


def diff_sets(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, change, value): members of an array column that came or went, as warnings do."""
    both = old.select(key, F.col(column).alias("__a")).join(new.select(key, F.col(column).alias("__b")), key, "full")
    none = F.array().cast(old.schema[column].dataType)
    a, b = F.coalesce("__a", none), F.coalesce("__b", none)
    rows = F.concat(F.transform(F.array_except(b, a), lambda v: F.struct(F.lit("added").alias("change"), v.alias("value"))), F.transform(F.array_except(a, b), lambda v: F.struct(F.lit("removed").alias("change"), v.alias("value"))))
    return both.select(key, F.explode(rows).alias("d")).select(key, "d.*")


def diff_amounts(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, delta): how much each number grew; a missing side counts as 0."""
    a, b = (df.select(key, *[F.col(f).alias(f"{f}_{s}") for f in fields]) for df, s in ((old, "old"), (new, "new")))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(f"{f}_new", F.lit(0)) - F.coalesce(f"{f}_old", F.lit(0))).alias("delta")) for f in fields])
    return a.join(b, key, "full").select(key, F.explode(rows).alias("d")).select(key, "d.*")


COLOURS = {"added": "green", "removed": "red", "modified": "yellow", "reordered": "blue", "budget": "magenta", "metadata": "cyan"}


def render(changes: DataFrame, form: str = "text", most: int = 50) -> str:
    """A report of counts by kind and of the first `most` changes by segment: text, json, or text with colour marks
    (rich).  Only these rows come to the driver."""
    counts = {r["change"]: r["n"] for r in diff_summary(changes).collect()}
    rows = [r.asDict() for r in changes.orderBy("segment_id", "change").limit(most).collect()]
    if form == "json":
        return json.dumps({"summary": counts, "entries": rows}, ensure_ascii=False, indent=2)
    if form not in ("text", "rich"):
        raise ValueError(f"unknown form {form}")
    shown = lambda kind, text: f"[{COLOURS[kind]}]{text}[/{COLOURS[kind]}]" if form == "rich" else text
    lines = ["Summary", *[f"  {shown(k, f'{k}: {n}')}" for k, n in sorted(counts.items()) if n]]
    if rows:
        lines += ["Changes", *[f"  {shown(r['change'], r['change'])} {r['segment_id']}: {r['old_value']} -> {r['new_value']}" for r in rows]]
    more = sum(counts.values()) - len(rows)
    return "\n".join(lines + ([f"  and {more} more"] if more > 0 else []))


# --- golden checks ---


def within(expected: Column, actual: Column, tolerance: float = 0.05) -> Column:
    return F.when(expected == 0, True).otherwise(F.abs(expected - actual) / expected <= tolerance)


def golden(expected: DataFrame, actual: DataFrame, key: str, exact: list[str], near: list[str], tolerance: float = 0.05, custom: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """(key, check, passed): equality of `exact` columns, tolerance for `near` ones, and conditions of one's own on the
    actual rows; a missing side fails, and so does a condition that can't be built or is null."""
    both = expected.select(key, *[F.col(c).alias(f"{c}_e") for c in exact + near]).join(actual.select(key, *[F.col(c).alias(f"{c}_a") for c in exact + near]), key, "full")
    checks = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(f"{c}_e") == F.col(f"{c}_a"), F.lit(False)).alias("passed")) for c in exact]
    checks += [F.struct(F.lit(c).alias("check"), F.coalesce(within(F.col(f"{c}_e"), F.col(f"{c}_a"), tolerance), F.lit(False)).alias("passed")) for c in near]
    none = F.array().cast("array<struct<check:string,passed:boolean>>")
    out = both.select(key, F.explode(F.array(*checks) if checks else none).alias("c")).select(key, "c.*")
    for name, condition in (custom or {}).items():
        try:
            own = actual.select(key, F.lit(name).alias("check"), F.coalesce(condition(actual).cast("boolean"), F.lit(False)).alias("passed"))
        except Exception as error:  # the condition's own failure
            warnings.warn(f"check {name}: {error}", stacklevel=2)
            own = actual.select(key, F.lit(name).alias("check"), F.lit(False).alias("passed"))
        out = out.unionByName(own)
    return out


def same_as_snapshot(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: whether two builds' segments differ in nothing, and how many changes there are."""
    return diff_segments(expected, actual).agg((F.count("*") == 0).alias("passed"), F.count("*").alias("changes"))


def golden_run(checks: DataFrame, key: str) -> DataFrame:
    return checks.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.sum((~F.col("passed")).cast("int")).alias("failed"))


# --- metrics ---


def ring(points: DataFrame, most: int, name: str = "name", at: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last `most` points of each name."""
    order = Window.partitionBy(name).orderBy(*[F.desc(c) for c in at])
    return points.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= most).drop("age")


def percentiles(points: DataFrame, by: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """(by, one column per share): percentiles with linear interpolation, exact.

    Values are counted first and dealt to ranges of (by, value), so a group with most of the rows is many tasks; a range
    knows its first rank from the counts of those before it, and only the values around a wanted rank go on."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, value]
    counts = points.filter(F.col(value).isNotNull()).groupBy(*order).agg(F.count("*").alias("__n"))
    ranged = written(counts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__own"))  # a row for each group and range it lies in
    w = Window.partitionBy(*by).orderBy("__part")
    totals = totals.withColumn("__before", F.coalesce(F.sum("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__own").over(Window.partitionBy(*by)))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.withColumn("__upto", upto).join(totals, [*by, "__part"])
    last = F.col("__before") + F.col("__upto") - 1
    first = last - F.col("__n") + 1
    picked = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__all") - 1)
        low, high, part = F.floor(at), F.ceil(at), at - F.floor(at)
        picked += [F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"__{name}_low"), F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"__{name}_high"), F.max(part).alias(f"__{name}_part")]
    found = ranks.groupBy(*by).agg(*picked)
    return found.select(*by, *[(F.col(f"__{n}_low") + (F.col(f"__{n}_high") - F.col(f"__{n}_low")) * F.col(f"__{n}_part")).alias(n) for n in shares])


def summary(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Count, least, greatest, mean and interpolated percentiles."""
    basic = points.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))
    own = percentiles(points, by, {f"p{k}": k / 100 for k in (50, 95, 99)}, value)
    on = [basic[c].eqNullSafe(own[c]) for c in by]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return basic.join(own, condition, "left").select(*[basic[c] for c in by], "n", "least", "greatest", "mean", "p50", "p95", "p99")


def package_metrics(segments: DataFrame, audit: DataFrame, available: int) -> DataFrame:
    """(request_id, name, value) points of a build: tokens, segments, drops, utilisation where there is a budget, and
    truncations where there are any."""
    used = segments.groupBy(REQUEST).agg(F.sum("token_count").cast("double").alias("total_tokens"), F.count("*").cast("double").alias("segment_count"))
    counts = audit.groupBy(REQUEST).agg(*[F.sum((F.col("decision") == d).cast("int")).cast("double").alias(n) for d, n in (("drop", "dropped_count"), ("truncate", "truncated_count"))])
    rows = used.join(counts, REQUEST, "left").withColumn("dropped_count", F.coalesce("dropped_count", F.lit(0.0)))
    names = ["total_tokens", "segment_count", "dropped_count", "truncated_count"]
    if available > 0:
        rows, names = rows.withColumn("token_utilization", F.col("total_tokens") / available), [*names, "token_utilization"]
    points = rows.unpivot(REQUEST, names, "name", "value").filter("value is not null")
    return points.filter("name <> 'truncated_count' or value > 0")


def names(points: DataFrame, name: str = "name") -> DataFrame:
    return points.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))


def export(points: DataFrame, path: str, name: str = "name") -> None:
    """All points as JSON lines, a folder for each name."""
    points.write.partitionBy(name).json(path)


def by_model(segments: DataFrame, model: str = "model") -> DataFrame:
    """Builds, tokens and tokens a build of each model."""
    rows = segments.groupBy(F.col(model).alias("model")).agg(F.countDistinct(REQUEST).alias("snapshots"), F.sum("token_count").alias("tokens"))
    return rows.withColumn("mean", F.col("tokens") / F.col("snapshots"))


def decisions(audit: DataFrame) -> DataFrame:
    return audit.groupBy("decision").agg(F.count("*").alias("n"))


def tagged(tags: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.coalesce(tags[k], F.lit("")) == v)
    return out


# --- lint: (request_id, rule, severity, n, worst) ---


def _finding(df: DataFrame, rule: str, severity: str, n: Column, worst: Column | None = None) -> DataFrame:
    return df.select(REQUEST, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), n.cast("long").alias("n"), (F.lit(None) if worst is None else worst).cast("double").alias("worst"))


def missing_tokens(segments: DataFrame) -> DataFrame:
    bad = segments.filter("token_count is null or token_count = 0").groupBy(REQUEST).agg(F.count("*").alias("k"))
    return _finding(bad, "missing_token_count", "critical", F.col("k"))


def namespace_leak(segments: DataFrame, target: str = "default") -> DataFrame:
    bad = segments.filter((F.col("namespace") != target) & (F.col("namespace") != "global")).groupBy(REQUEST, "namespace").agg(F.count("*").alias("k"))
    return _finding(bad, "namespace_leak", "critical", F.col("k"))


def circular(edges: DataFrame) -> DataFrame:
    """Nodes of (request_id, segment_id, depends_on) on or behind no way out: what peeling nodes without unpeeled
    dependencies leaves, that is every cycle and what depends on one.  A request's graph is peeled in one task: it is
    as small as its prompt."""
    import pandas as pd

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        needs: dict[str, set[str]] = {}
        for a, b in zip(pdf["segment_id"], pdf["depends_on"]):
            needs.setdefault(a, set()).add(b)
        while free := [a for a, deps in needs.items() if not deps & needs.keys()]:
            for a in free:
                del needs[a]
        return pd.DataFrame({REQUEST: [pdf[REQUEST].iloc[0]] * len(needs), "segment_id": pd.Series(sorted(needs), dtype=object)})

    kind = edges.schema[REQUEST].dataType.simpleString()
    return edges.groupBy(REQUEST).applyInPandas(peel, f"{REQUEST} {kind}, segment_id string")


def too_many_critical(segments: DataFrame, most: float = 0.5) -> DataFrame:
    share = segments.groupBy(REQUEST).agg(F.avg((F.coalesce("priority", F.lit("")) == "critical").cast("int")).alias("share"), F.count("*").alias("k"))
    return _finding(share.filter(F.col("share") > most), "too_many_critical", "warning", F.col("k"), F.col("share"))


def rigid_too_large(segments: DataFrame, available: int, most: float = 0.7) -> DataFrame:
    used = segments.groupBy(REQUEST).agg(F.sum(F.when(F.col("type").isin("system", "schema"), F.col("token_count")).otherwise(0)).alias("k"))
    return _finding(used.filter(F.col("k") / available > most), "rigid_too_large", "warning", F.col("k"), F.col("k") / available)


def outdated(segments: DataFrame, now: Column, days: int = 30) -> DataFrame:
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("injected_at")) / 86400)
    bad = segments.withColumn("age", age).filter(F.col("age") > days).groupBy(REQUEST).agg(F.count("*").alias("k"), F.max("age").alias("w"))
    return _finding(bad, "outdated", "warning", F.col("k"), F.col("w"))


def over_compressed(audit: DataFrame, least: float = 0.1) -> DataFrame:
    bad = audit.filter((F.col("decision") == "compress") & (F.col("ratio") < least)).groupBy(REQUEST).agg(F.count("*").alias("k"), F.min("ratio").alias("w"))
    return _finding(bad, "over_compressed", "warning", F.col("k"), F.col("w"))


def idle_routing(routed: DataFrame, least: float = 0.1) -> DataFrame:
    gap = F.abs(F.col("window_a") - F.col("window_b")) / F.greatest("window_a", "window_b")
    return _finding(routed.filter(gap < least), "idle_routing", "info", F.lit(1), gap)


def shared_sources(segments: DataFrame) -> DataFrame:
    per = segments.groupBy(REQUEST, "source_id").agg(F.count("*").alias("k")).filter("k > 1").groupBy(REQUEST).agg(F.count("*").alias("k"))
    return _finding(per, "shared_source", "info", F.col("k"))


def unsanitised(segments: DataFrame, audit: DataFrame) -> DataFrame:
    risky = segments.filter(F.col("type").isin("user", "rag", "tool_result")).groupBy(REQUEST).agg(F.count("*").alias("k"))
    return _finding(risky.join(audit.filter("decision = 'sanitize'").select(REQUEST).distinct(), REQUEST, "left_anti"), "unsanitised", "info", F.col("k"))


def detect(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.withColumn("severity_rank", F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2))


SEVERITIES = ("critical", "warning", "info")


class Rules:
    """Named rules: functions of a context (any object) to findings."""

    def __init__(self):
        self._rules: dict[str, tuple[str, Callable]] = {}

    def register(self, name: str, severity: str, rule: Callable) -> None:
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity {severity}")
        self._rules[name] = (severity, rule)

    def unregister(self, name: str) -> None:
        self._rules.pop(name, None)

    @property
    def names(self) -> list[str]:
        """The most severe first."""
        return sorted(self._rules, key=lambda n: SEVERITIES.index(self._rules[n][0]))

    def detect(self, context, apart: bool = True) -> DataFrame | None:
        """The findings of all rules.  One that fails is left out with a warning; apart runs each by itself, so that this
        holds for failures on rows as well."""
        found = []
        for name in self.names:
            try:
                rows = self._rules[name][1](context)
                found.append(written(rows) if apart else rows)
            except Exception as error:  # the rule's own failure
                warnings.warn(f"rule {name}: {error}", stacklevel=2)
        return detect(*found) if found else None


def default_rules(available: int, critical: float = 0.5, rigid: float = 0.7, ratio: float = 0.1, days: int = 30, now: Column | None = None) -> Rules:
    """Rules on a context with segments, audit and target; those that need more columns are for the caller to add."""
    out = Rules()
    out.register("missing_token_count", "critical", lambda c: missing_tokens(c.segments))
    out.register("namespace_leak", "critical", lambda c: namespace_leak(c.segments, getattr(c, "target", "default")))
    out.register("too_many_critical", "warning", lambda c: too_many_critical(c.segments, critical))
    out.register("rigid_too_large", "warning", lambda c: rigid_too_large(c.segments, available, rigid))
    out.register("over_compressed", "warning", lambda c: over_compressed(c.audit, ratio))
    out.register("shared_source", "info", lambda c: shared_sources(c.segments))
    out.register("unsanitised", "info", lambda c: unsanitised(c.segments, c.audit))
    if now is not None:
        out.register("outdated", "warning", lambda c: outdated(c.segments, now, days))
    return out


def report(findings: DataFrame, form: str = "text", most: int = 50) -> str:
    """Counts by severity and the first `most` findings, as text or json; only these rows come to the driver."""
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    rows = [r.asDict() for r in findings.orderBy("severity_rank", "rule", REQUEST).limit(most).collect()]
    if form == "json":
        return json.dumps({"total": sum(counts.values()), "by_severity": {s: counts.get(s, 0) for s in SEVERITIES}, "results": rows}, ensure_ascii=False, indent=2)
    if not rows:
        return "nothing found"
    return "\n".join([*[f"{s}: {counts.get(s, 0)}" for s in SEVERITIES], *[f"  [{r['severity']}] {r['rule']} in {r[REQUEST]}: {r['n']}" for r in rows]])


# --- agents ---


def register(agents: DataFrame, more: DataFrame) -> DataFrame:
    """agents (agent_id, namespace, ...) with more of them; an agent that is there is replaced."""
    return agents.join(more.select("agent_id"), "agent_id", "left_anti").unionByName(more)


def unregister(agents: DataFrame, agent_id: str) -> DataFrame:
    return agents.filter(F.col("agent_id") != agent_id)


def may_see(agents: DataFrame, spaces: DataFrame) -> DataFrame:
    """(agent_id, namespace, allowed): an agent has its own namespace and the default one.  Both are short lists, but the
    pairs come from an array of the agents, so no join is made."""
    registry = agents.agg(F.collect_list(F.struct("agent_id", F.col("namespace").alias("own"))).alias("agents")).scalar()
    return spaces.select("namespace", F.explode(registry).alias("a")).select("a.agent_id", "namespace", ((F.col("a.own") == F.col("namespace")) | (F.col("namespace") == "default")).alias("allowed"))



def publish(segments: DataFrame, agents: DataFrame) -> DataFrame:
    """segments (with agent_id): those of the default namespace go to their agent's."""
    named = segments.join(agents.select("agent_id", F.col("namespace").alias("own")), "agent_id")
    return named.withColumn("namespace", F.when(F.col("namespace") == "default", F.col("own")).otherwise(F.col("namespace"))).drop("own")


def views(agents: DataFrame, segments: DataFrame) -> DataFrame:
    """(agent_id, segment_id): an agent sees its own namespace but what is internal, the default one as visible to it,
    and of others what is global or handed downstream.  Two joins on keys instead of one on a disjunction; what is
    shared with everyone is repeated for each agent from the registry, which is one short array."""
    own = agents.join(segments.filter("visibility <> 'INTERNAL'"), "namespace").select("agent_id", "segment_id")
    a = agents.select("agent_id", F.col("namespace").alias("view"))
    general = a.filter("view <> 'default'").withColumn("namespace", F.lit("default")).join(segments, "namespace").filter(visible_to(F.col("view"))).select("agent_id", "segment_id")
    registry = agents.agg(F.collect_list(F.struct("agent_id", "namespace")).alias("agents")).scalar()
    shared = segments.filter("visibility in ('GLOBAL', 'DOWNSTREAM') and namespace <> 'default'")
    others = shared.select("namespace", "segment_id", F.explode(registry).alias("a")).filter("a.namespace <> namespace").select("a.agent_id", "segment_id")
    return own.union(general).union(others).distinct()


def hand_off(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """requests (source, target, segment_ids or null): copies, in the target's namespace, of the source's listed segments,
    or of all that aren't internal."""
    rows = segments.withColumnRenamed("namespace", "source").join(requests, "source")
    wanted = F.when(F.col("segment_ids").isNull(), F.col("visibility") != "INTERNAL").otherwise(F.array_contains("segment_ids", F.col("segment_id")))
    return rows.filter(wanted).select("segment_id", F.col("target").alias("namespace"), "source", "token_count")


def hand_off_agents(requests: DataFrame, agents: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (from_agent, to_agent, segment_ids or null, reason): the copies of hand_off(), and an event for each
    request (event_type, publisher_id, to_agent, segment_count, reason).  An agent that isn't registered is an error."""
    for side in ("from_agent", "to_agent"):
        unknown = requests.select(F.col(side).alias("agent_id")).join(agents, "agent_id", "left_anti").limit(1).collect()
        if unknown:
            raise KeyError(f"agent {unknown[0][0]} isn't registered")
    spaces = agents.select("agent_id", "namespace")
    named = requests.join(spaces.toDF("from_agent", "source"), "from_agent").join(spaces.toDF("to_agent", "target"), "to_agent")
    copies = hand_off(named.select("source", "target", "segment_ids"), segments)
    counted = copies.groupBy("source", F.col("namespace").alias("target")).agg(F.count("*").alias("segment_count"))
    events = named.join(counted, ["source", "target"], "left").select(F.lit("context_handoff").alias("event_type"), F.col("from_agent").alias("publisher_id"), "to_agent", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), "reason")
    return copies, events


def clear_namespace(segments: DataFrame, namespace: str) -> DataFrame:
    return segments.filter(F.col("namespace") != namespace)


def recent_events(events: DataFrame, most: int = 10, kind: str | None = None) -> DataFrame:
    return (events.filter(F.col("event_type") == kind) if kind else events).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def namespace_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("namespace", "type").agg(F.count("*").alias("segments"), F.sum("token_count").alias("tokens"))


# --- cache ---


def lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests (key) with hit and value: entries (key, value, created, ttl in seconds or null) that haven't expired."""
    live = prune(cache, now)
    return requests.join(live.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def two_level(requests: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """requests with value and level (L1, L2 or miss); rows of level L2 are those to be promoted."""
    a, b = first.select("key", F.col("value").alias("v1")), second.select("key", F.col("value").alias("v2"))
    return requests.join(a, "key", "left").join(b, "key", "left").select("key", F.coalesce("v1", "v2").alias("value"), F.when(F.col("v1").isNotNull(), "L1").when(F.col("v2").isNotNull(), "L2").otherwise("miss").alias("level"))


def cache_stats(looked_up: DataFrame, sets: int = 0, evictions: int = 0) -> DataFrame:
    hits = F.sum(F.col("hit").cast("int"))
    rows = looked_up.agg(F.coalesce(hits, F.lit(0)).alias("hits"), (F.count("*") - F.coalesce(hits, F.lit(0))).alias("misses"), F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_rate"))
    return rows.withColumns({"sets": F.lit(sets), "evictions": F.lit(evictions), "eviction_rate": F.lit(evictions / sets if sets else 0.0)})


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """cache with entries set; a key that is there is replaced."""
    return cache.join(entries.select("key"), "key", "left_anti").unionByName(entries)


def forget(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def prune(cache: DataFrame, now: Column) -> DataFrame:
    """The entries that haven't expired."""
    return cache.filter(F.col("ttl").isNull() | (F.unix_timestamp("created") + F.col("ttl") > F.unix_timestamp(now)))


def least_recent(cache: DataFrame, most: int) -> DataFrame:
    """What a cache of `most` entries keeps: those used last.  A top-k, not a sort of all."""
    return cache.orderBy(F.desc("used"), "key").limit(most)
