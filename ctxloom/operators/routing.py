"""Choosing a model for each request."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that tell a query's kind.
COMPARE = ("比较", "对比", "区别", "差异", "优缺点", "优劣", "哪个更好", "compare", "contrast", "difference", "versus", "vs", "better", "pros and cons", "advantages", "disadvantages")
REASON = ("为什么", "如何", "怎么", "解释", "原理", "机制", "原因", "why", "how", "explain", "reasoning", "rationale", "mechanism")
TASK = ("分析", "设计", "生成", "创建", "实现", "优化", "评估", "证明", "推导", "计算", "编写代码", "写代码", "analyze", "design", "generate", "create", "implement", "optimize", "evaluate", "prove", "derive", "calculate", "write code", "code")
MATH = r"[∫∑∏√∂∇≈≠≤≥±∞∈∉⊂⊃∪∩]|\\frac|\\int|\\sum"
CODE = r"(?m)```[\s\S]*?```|^[ ]{4,}.+$"

# Models as (id, provider, context, output, thinking, tools, vision, cost in, cost out per million).
MODELS = [
    ("gpt-4o", "openai", 128000, 16384, False, True, True, 2.5, 10.0),
    ("gpt-4o-mini", "openai", 128000, 16384, False, True, True, 0.15, 0.6),
    ("gpt-4-turbo", "openai", 128000, 4096, False, True, True, 10.0, 30.0),
    ("o1", "openai", 200000, 100000, True, True, True, 15.0, 60.0),
    ("o3-mini", "openai", 200000, 100000, True, True, False, 1.1, 4.4),
    ("claude-opus-4-20250115", "anthropic", 200000, 32000, True, True, True, 15.0, 75.0),
    ("claude-sonnet-4-5-20250514", "anthropic", 200000, 16000, True, True, True, 3.0, 15.0),
    ("claude-haiku-3-5-20241022", "anthropic", 200000, 8192, False, True, True, 0.8, 4.0),
    ("gemini-2.0-flash", "google", 1048576, 8192, True, True, True, 0.1, 0.4),
    ("gemini-2.5-pro", "google", 1048576, 65536, True, True, True, 1.25, 10.0),
    ("llama-3.1-70b", "local", 128000, 4096, False, True, False, 0.0, 0.0),
    ("deepseek-v3", "deepseek", 128000, 8192, False, True, False, 0.27, 1.1),
    ("qwen-2.5-72b", "local", 131072, 8192, False, True, False, 0.0, 0.0),
]
ALIASES = {
    "gpt4o": "gpt-4o", "gpt4o-mini": "gpt-4o-mini", "4o": "gpt-4o", "4o-mini": "gpt-4o-mini",
    "claude-opus": "claude-opus-4-20250115", "claude-sonnet": "claude-sonnet-4-5-20250514", "claude-haiku": "claude-haiku-3-5-20241022",
    "opus": "claude-opus-4-20250115", "sonnet": "claude-sonnet-4-5-20250514", "haiku": "claude-haiku-3-5-20241022",
    "gemini-flash": "gemini-2.0-flash", "gemini-pro": "gemini-2.5-pro", "llama": "llama-3.1-70b", "deepseek": "deepseek-v3", "qwen": "qwen-2.5-72b",
}
MODEL_SCHEMA = "model string, provider string, max_context int, max_output int, thinking boolean, tools boolean, vision boolean, cost_in double, cost_out double"


def models(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*MODELS, *more], MODEL_SCHEMA)


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def signals(df: DataFrame, text: str = "query") -> DataFrame:
    """df with what tells a query's complexity.  An ASCII question mark counts twice."""
    q, low = F.col(text), F.lower(text)
    return df.withColumns({
        "query_length": F.length(q),
        "words": F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")),
        "questions": 2 * F.regexp_count(q, F.lit(r"\?")),
        "code_blocks": F.regexp_count(q, F.lit(CODE)),
        "math": F.regexp_count(q, F.lit(MATH)),
        "compares": _any(low, COMPARE),
        "reasons": _any(low, REASON),
        "task": _any(low, TASK),
    })


def complexity(df: DataFrame, short: int = 80, moderate: int = 200, long: int = 500) -> DataFrame:
    """df of signals() with points, confidence and level."""
    n = F.col("query_length")
    steps = [(F.when(n > long, 3.0).when(n > moderate, 2.0).when(n > short, 1.0).otherwise(0.0), F.when(n > long, 0.15).when(n > moderate, 0.1).when(n > short, 0.05).otherwise(0.0))]
    for name, points, sure in (("task", 2.0, 0.2), ("compares", 1.0, 0.1), ("reasons", 0.5, 0.05)):
        steps.append((F.when(F.col(name), points).otherwise(0.0), F.when(F.col(name), sure).otherwise(0.0)))
    steps.append((F.when(F.col("code_blocks") > 0, 1.5).otherwise(0.0), F.when(F.col("code_blocks") > 0, 0.15).otherwise(0.0)))
    steps.append((F.when(F.col("math") > 3, 1.5).when(F.col("math") > 0, 0.5).otherwise(0.0), F.when(F.col("math") > 3, 0.15).otherwise(0.0)))
    steps.append((F.when(F.col("questions") > 2, 1.0).otherwise(0.0), F.when(F.col("questions") > 2, 0.1).otherwise(0.0)))
    points, sure = F.lit(0.0), F.lit(0.5)
    for p, c in steps:
        points, sure = points + p, sure + c
    level = F.when(F.col("points") >= 5, "expert").when(F.col("points") >= 3.5, "complex").when(F.col("points") >= 1.5, "moderate").otherwise("simple")
    return df.withColumn("points", points).withColumn("confidence", F.least(F.lit(1.0), sure)).withColumn("level", level)


def token_range(tokens: Column, text: str) -> Column:
    """">n", "<n", "a-b" with both ends, or "n"; anything else matches nothing."""
    text = text.strip()
    try:
        if text[:1] == ">":
            return tokens > int(text[1:])
        if text[:1] == "<":
            return tokens < int(text[1:])
        if "-" in text:
            low, high = text.split("-", 1)
            return tokens.between(int(low), int(high))
        return tokens == int(text)
    except ValueError:
        return F.lit(False)


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    value: str
    model: str
    priority: int = 0

    def matches(self) -> Column:
        if self.kind == "complexity":
            return F.col("level") == self.value
        if self.kind == "keyword":
            return F.col("query").rlike(f"(?i){self.value}")
        if self.kind == "token_range":
            return token_range(F.col("tokens"), self.value)
        if self.kind == "segment_type_present":
            return F.array_contains("types", self.value)
        return F.lit(False)


DEFAULT_RULES = (
    Rule("expert", "complexity", "expert", "claude-opus", 40),
    Rule("complex", "complexity", "complex", "claude-sonnet", 30),
    Rule("moderate", "complexity", "moderate", "gpt-4o", 20),
    Rule("simple", "complexity", "simple", "gpt-4o-mini", 10),
)


@dataclass(frozen=True)
class Router:
    rules: tuple[Rule, ...] = DEFAULT_RULES
    default: str = "gpt-4o-mini"
    more_models: list[tuple] = field(default_factory=list)

    def route(self, df: DataFrame) -> DataFrame:
        """df with rule, model and cost: the first matching rule by priority, else the default.  The rules are a chain
        of conditions, so no row is joined with any."""
        known = {m[0]: m for m in [*MODELS, *self.more_models]}
        rule, model = F.lit(None).cast("string"), F.lit(resolve(self.default, known))
        for r in sorted(self.rules, key=lambda r: r.priority):
            hit = r.matches()
            rule = F.when(hit, r.name).otherwise(rule)
            model = F.when(hit, resolve(r.model, known) or resolve(self.default, known)).otherwise(model)
        out = df.withColumn("rule", F.coalesce(rule, F.lit("default"))).withColumn("model", model)
        column = lambda i: F.create_map(*[F.lit(x) for m in known.values() for x in (m[0], float(m[i]))])[F.col("model")]
        return out.withColumn("cost", F.col("tokens") / 1e6 * column(7) + column(3) / 1e6 * column(8))


def resolve(name: str, known: dict | None = None) -> str | None:
    """A model's id by id, alias, or a prefix either way, longest ids first."""
    known = known or {m[0]: m for m in MODELS}
    if name in known:
        return name
    if ALIASES.get(name) in known:
        return ALIASES[name]
    low = name.lower()
    return next((m for m in sorted(known, key=lambda m: -len(m)) if low.startswith(m.lower()) or m.lower().startswith(low)), None)


def resolve_names(df: DataFrame, name: str = "name") -> DataFrame:
    """df with model: as resolve(), by a chain of the registry's few entries."""
    low = F.lower(name)
    by_prefix = F.lit(None).cast("string")
    for m in reversed(sorted((m[0] for m in MODELS), key=lambda m: -len(m))):  # of one length the first counts
        by_prefix = F.when(low.startswith(m.lower()) | F.lit(m.lower()).startswith(low), m).otherwise(by_prefix)
    exact = F.when(F.col(name).isin([m[0] for m in MODELS]), F.col(name))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.col(name)]
    return df.withColumn("model", F.coalesce(exact, alias, by_prefix))


def query_text(messages: DataFrame, system: DataFrame) -> DataFrame:
    """(request_id, query): the system prompt and the last user message."""
    last = messages.filter("role = 'user'").groupBy("request_id").agg(F.max_by("content", "at").alias("last"))
    return last.join(system, "request_id", "full").select("request_id", F.concat_ws(" ", F.coalesce("system_prompt", F.lit("")), F.coalesce("last", F.lit(""))).alias("query"))


def mock_level(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 50, "simple").when(n < 150, "moderate").when(n < 400, "complex").otherwise("expert")


def llm_answers(df: DataFrame, provider, text: str = "query", known: DataFrame | None = None) -> DataFrame:
    """(text, level) of each distinct query: from known, what was answered before, else by provider (prompt to JSON),
    which is asked once; no level where it fails or its answer is bad.  Keep the rows with a level for the next run."""

    @F.pandas_udf("string")
    def ask(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            try:
                return provider(v)
            except Exception:  # a provider's failure is one query's fallback
                return ""

        return values.map(one)

    asked = df.select(text).distinct()
    new = asked if known is None else asked.join(known.select(text), text, "left_anti")
    plain = F.regexp_replace(ask(text), r"(?s)^\s*```(?:json)?|```\s*$", "")
    level = F.lower(F.get_json_object(plain, "$.complexity"))
    found = new.select(text, F.when(level.isin("simple", "moderate", "complex", "expert"), level).alias("level"))
    return found if known is None else found.unionByName(known.select(text, "level").join(asked, text, "left_semi"))


def llm_levels(df: DataFrame, provider, text: str = "query", known: DataFrame | None = None) -> DataFrame:
    """df with level as answered (see llm_answers); where there is no answer by the rules' own estimate."""
    own = complexity(signals(df.select(text).distinct(), text)).select(text, F.col("level").alias("__estimate"))
    answers = llm_answers(df, provider, text, known).join(own, text)
    return df.join(answers.select(text, F.coalesce("level", "__estimate").alias("level")), text)
