"""Cache keys: hashes of JSON, whose quotes and brackets no text can fake; nulls are written as such."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.functions.text import nfc


def _hash(value: Column) -> Column:
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def normalised(text: Column) -> Column:
    """NFC with white space collapsed."""
    return F.trim(F.regexp_replace(nfc(text), r"(?U)\s+", " "))


def build_key(**parts: Column) -> Column:
    """Of named inputs, whatever their order."""
    return _hash(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))


def segment_key(model: Column, text: Column, normalise: bool = True) -> Column:
    return F.concat_ws(":", F.lit("segment"), model, F.sha2(normalised(text) if normalise else text, 256))


def prefix_key(model: Column, texts: Column, version: Column | None = None) -> Column:
    """Depends on the order of texts (an array) and on where one ends; the version defaults to "default"."""
    version = F.lit("default") if version is None else F.coalesce(version, F.lit("default"))
    return F.concat_ws(":", F.lit("prefix"), model, version, _hash(texts))


def context_key(model: Column, version: Column | None, segments: Column) -> Column:
    """segments: an array of structs, or one; a struct's fields count by name, so let them be in the names' order."""
    version = F.lit("default") if version is None else F.coalesce(version, F.lit("default"))
    return F.concat_ws(":", F.lit("context"), model, version, _hash(segments))


def prefix_match_key(model: Column, version: Column, system: Column, messages: Column, depth: Column | None = None) -> Column:
    """Of the system text and the first `depth` messages, all but the last by default; 16 hex digits."""
    depth = F.size(messages) - 1 if depth is None else depth
    first = F.slice(messages, F.lit(1), F.greatest(depth, F.lit(0)))
    return F.concat_ws(":", F.lit("prefix_match"), model, version, F.substring(_hash(F.concat(F.array(system), first)), 1, 16))


def parse_key(key: Column) -> Column:
    """struct(kind, model, version, hash); of an unknown form only kind, as raw, and hash, the whole."""
    parts = F.split(key, ":")
    n = F.size(parts)

    def struct(kind, model, version, hashed):
        return F.struct(kind.alias("kind"), model.alias("model"), version.alias("version"), hashed.alias("hash"))

    none = F.lit(None).cast("string")
    return F.when((parts[0] == "segment") & (n == 3), struct(parts[0], F.get(parts, 1), none, F.get(parts, 2))).when(parts[0].isin("prefix", "context", "prefix_match") & (n == 4), struct(parts[0], F.get(parts, 1), F.get(parts, 2), F.get(parts, 3))).otherwise(struct(F.lit("raw"), none, none, key))
