"""Policy files: found, merged with overrides, checked, and turned into settings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ctxloom.operators.budget import Policy
from ctxloom.plans.pipeline import Settings
from ctxloom.sources.ingest import BY_TYPE
from ctxloom.sources.store import load_requests, merged

# Sections, fields, defaults and bounds (least, greatest; above: the least is no value itself).
SEARCHED = ("policy.yaml", "policy.yml", "configs/default_policy.yaml")
FIELDS: dict[str, dict[str, tuple]] = {
    "budget": {"max_context_tokens": (128_000, "above", 0, None), "output_reserved_tokens": (4_096, "from", 0, None), "thinking_reserved_tokens": (0, "from", 0, None), "saturation_threshold": (0.85, "from", 0, 1), "overflow_strategy": ("truncate_lowest_priority",), "elastic_ratios": ({"rag": 0.35, "user": 0.15, "assistant": 0.25, "few_shot": 0.10, "tool_result": 0.10, "tool_definition": 0.05},)},
    "sanitize": {"unicode_normalize": (True,), "strip_html": (True,), "pii_redaction": (False,), "injection_detection": (True,), "max_segment_chars": (50_000, "above", 0, None), "max_repeat_chars": (100, "above", 0, None), "on_injection": ("warn_and_remove",), "injection_level": ("heuristic",), "injection_confidence_threshold": (0.7, "from", 0, 1), "pii_patterns": (["phone", "email", "id_card"],)},
    "rerank": {"enable_mmr": (False,), "mmr_lambda": (0.7, "from", 0, 1), "similarity_threshold": (0.85, "from", 0, 1), "max_per_type": (0, "from", 0, None), "enable_temporal_weighting": (False,), "temporal_decay_rate": (0.1, "from", 0, 1), "temporal_min_weight": (0.3, "from", 0, 1)},
    "compress": {"enabled": (True,), "default_compressor": ("truncation",), "saturation_trigger": (0.85, "from", 0, 1), "preserve_must_keep": (True,), "min_segment_tokens": (50, "above", 0, None)},
    "cache": {"enabled": (True,), "backend": ("memory",), "prefix_cache": (True,), "semantic_cache": (False,), "ttl_seconds": (3600, "above", 0, None), "max_entries": (1000, "above", 0, None)},
    "routing": {"enabled": (False,), "default_model": ("gpt-4o",), "router_type": ("rule_based",), "rules": ([],)},
    "observability": {"snapshot_enabled": (True,), "tracing_enabled": (False,), "metrics_enabled": (True,), "export_format": ("json",), "snapshot_dir": ("snapshots",)},
    "antipattern": {"enabled": (True,), "critical_ratio_threshold": (0.5, "from", 0, 1), "rigid_budget_threshold": (0.7, "from", 0, 1), "compression_ratio_threshold": (0.1, "from", 0, 1), "ttl_days_threshold": (30, "above", 0, None), "routing_effectiveness_threshold": (0.1, "from", 0, 1), "check_on_build": (False,), "fail_on_critical": (False,)},
}
TOP = {"version": "1.0", "name": "default", "description": ""}
PII_NAMES = {"ip_address": "ip"}


class PolicyError(ValueError):
    """A file that is missing, unreadable, or has wrong fields; errors has a line for each."""

    def __init__(self, source: str, errors: list[str]):
        super().__init__(f"{source}: " + "; ".join(errors))
        self.errors = errors


def defaults() -> dict:
    return TOP | {section: {k: v[0].copy() if isinstance(v[0], (dict, list)) else v[0] for k, v in fields.items()} for section, fields in FIELDS.items()}


def _wrong(path: str, value, default, bounds: tuple) -> str | None:
    if isinstance(default, bool):
        return None if isinstance(value, bool) else f"{path}: true or false is expected"
    if isinstance(default, (int, float)):
        whole = isinstance(default, int)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or whole and value != int(value):
            return f"{path}: a {'whole number' if whole else 'number'} is expected"
        kind, least, greatest = bounds
        if value < least or kind == "above" and value == least or greatest is not None and value > greatest:
            return f"{path}: {value} is out of bounds"
        return None
    return None if isinstance(value, type(default)) else f"{path}: a {type(default).__name__} is expected"


def errors_of(config: dict) -> list[str]:
    """What is wrong with a configuration laid over the defaults; unknown fields are left aside."""
    out = []
    for section, fields in FIELDS.items():
        own = config.get(section, {})
        if not isinstance(own, dict):
            out.append(f"{section}: a mapping is expected")
            continue
        out += [e for k, v in fields.items() if k in own and (e := _wrong(f"{section}.{k}", own[k], v[0], v[1:]))]
    budget = config.get("budget")
    ratios = budget.get("elastic_ratios", {}) if isinstance(budget, dict) else {}
    if isinstance(ratios, dict):
        bad = [k for k, v in ratios.items() if isinstance(v, bool) or not isinstance(v, (int, float))]
        out += [f"budget.elastic_ratios.{k}: a number is expected" for k in bad]
        if not bad and sum(ratios.values()) > 1.01:
            out.append("budget.elastic_ratios: their sum is above 1")
    return out


def load_policy(spark: SparkSession, path: str | None = None, overrides: dict | None = None, searched: Iterable[str] = SEARCHED) -> dict:
    """The whole configuration: a file's (path, or the first of searched that is there, or none) over the defaults, and
    overrides over that, mapping by mapping."""
    found: dict = {}
    for place in [path] if path else searched:
        try:
            found = load_requests(spark, place) or {}
            break
        except AnalysisException as error:
            if path:
                raise PolicyError(place, ["no such file"]) from error
        except Exception as error:
            raise PolicyError(place, [f"unreadable: {error}"]) from error
    config = merged(found, overrides or {})
    if errors := errors_of(config):
        raise PolicyError(path or "policy", errors)
    whole = merged(defaults(), config)
    if "elastic_ratios" in config.get("budget", {}):  # a file's ratios replace the default ones as a whole
        whole["budget"]["elastic_ratios"] = dict(config["budget"]["elastic_ratios"])
    return whole


def policy_errors(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a file; nothing where it may be used."""
    try:
        load_policy(spark, path)
        return []
    except PolicyError as error:
        return error.errors


def budget_of(config: dict) -> Policy:
    """Types that aren't known are left out of the ratios."""
    b = config["budget"]
    ratios = {k: float(v) for k, v in b["elastic_ratios"].items() if k in BY_TYPE}
    return Policy(int(b["max_context_tokens"]), int(b["output_reserved_tokens"]), int(b["thinking_reserved_tokens"]), ratios=ratios, saturation=float(b["saturation_threshold"]), overflow=b["overflow_strategy"])


def settings_of(config: dict, **more) -> Settings:
    s, r, c = config["sanitize"], config["rerank"], config["compress"]
    masks = tuple(PII_NAMES.get(k, k) for k in s["pii_patterns"]) if s["pii_redaction"] else None
    return Settings(
        policy=budget_of(config), strip_html=s["strip_html"], masks=masks, detects=s["injection_detection"], on_injection=s["on_injection"], level=s["injection_level"], most_chars=int(s["max_segment_chars"]),
        decay=float(r["temporal_decay_rate"]) if r["enable_temporal_weighting"] else None, least_weight=float(r["temporal_min_weight"]), most_per_type=int(r["max_per_type"]) or None, diversity=r["enable_mmr"], relevance=float(r["mmr_lambda"]), similarity=float(r["similarity_threshold"]),
        compress=c["enabled"], compress_at=float(c["saturation_trigger"]), least_tokens=int(c["min_segment_tokens"]), **more,
    )
