"""Model output made safe: declared types, clamped lists, strict booleans and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANNOTATION
from .tokens import strip

TYPES = ("text", "api", "code", "table")
COHERENCES = ("high", "medium", "low")
RELATIONS = ("prerequisite", "constraint", "failure_handling", "follow_up")


def unfenced(raw: Column) -> Column:
    """JSON text without the code fence that models like to put around it."""
    return strip(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?|```$", ""))


def parsed(raw: Column) -> Column:
    """Variant of a JSON text; null if it isn't JSON."""
    return F.try_parse_json(unfenced(raw))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def topics(values: Column, limit: int = 5) -> Column:
    """Trimmed, cut to 50 characters, the first of each that differ by more than case, ``limit`` at most."""
    short = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.substring(strip(t), 1, 50)), lambda t: t != "")
    low = F.transform(short, F.lower)
    return F.slice(F.filter(short, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, limit)


def _texts(v: Column, path: str, most: int) -> Column:
    found = F.filter(F.transform(F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>")), strip), lambda t: t != "")
    return F.slice(found, 1, most)


def _one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def _once(v: Column, f: Callable[[Column], Column]) -> Column:
    """``f(v)`` with ``v`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def annotation(raw: Column) -> Column:
    """Annotation struct of a model's JSON, which is parsed once for all parts."""
    return _once(parsed(raw), _annotation)


def _annotation(v: Column) -> Column:
    truth = F.coalesce(_get(v, "$.has_code", "boolean"), F.coalesce(_get(v, "$.has_code", "string"), F.lit("")) != "")
    return F.struct(
        F.substring(F.coalesce(_get(v, "$.summary", "string"), F.lit("")), 1, 50).alias("summary"),
        _texts(v, "$.keywords", 6).alias("keywords"),
        _texts(v, "$.tags", 8).alias("tags"),
        _one_of(_get(v, "$.type", "string"), TYPES, "text").alias("type"),
        truth.alias("has_code"),
        _one_of(_get(v, "$.coherence", "string"), COHERENCES, "medium").alias("coherence"),
        topics(_get(v, "$.dependency_topics", "array<string>")).alias("dependency_topics"),
    ).cast(ANNOTATION)


def edge(v: Column) -> Column:
    """Edge struct of a variant, or null: a number is no boolean, a boolean no number, and every part must be usable."""
    return _once(v, _edge)


def _edge(v: Column) -> Column:
    target, reason = (strip(F.coalesce(_get(v, p, "string"), F.lit(""))) for p in ("$.node_id", "$.reason"))
    relation, required = strip(F.coalesce(_get(v, "$.relation_type", "string"), F.lit(""))), _get(v, "$.required", "boolean")
    confidence = F.when(_kind(v, "$.confidence") != "BOOLEAN", _get(v, "$.confidence", "string").try_cast("double"))
    topic = _first_text(v, ("$.topic", "$.topic_name", "$.topic_code"))
    good = (target != "") & (reason != "") & relation.isin(*RELATIONS) & (_kind(v, "$.required") == "BOOLEAN") & confidence.between(0.0, 1.0)
    return F.when(
        good,
        F.struct(target.alias("node_id"), relation.alias("relation_type"), required.alias("required"), confidence.alias("confidence"), F.substring(reason, 1, 200).alias("reason"), F.substring(topic, 1, 50).alias("topic")),
    )


def _first_text(v: Column, paths: tuple[str, ...]) -> Column:
    found = [strip(_get(v, p, "string")) for p in paths]
    return F.coalesce(*(F.when(t != "", t) for t in found))


def rewrites(raw: Column, limit: int = 3) -> Column:
    """Other wordings of a question out of a model's JSON list (bare, or under ``queries``)."""
    found = _once(parsed(raw), lambda v: F.coalesce(_get(v, "$", "array<string>"), _get(v, "$.queries", "array<string>"), F.array().cast("array<string>")))
    return F.slice(F.filter(F.transform(found, strip), lambda t: t != ""), 1, limit)


def rerank_scores(raw: Column) -> Column:
    """Map of node to score: rows without an id are skipped, the last of a node wins, no score counts as 0."""
    rows = _once(parsed(raw), lambda v: F.coalesce(_get(v, "$.scores", "array<variant>"), _get(v, "$", "array<variant>"), F.array().cast("array<variant>")))
    pairs = F.filter(F.transform(rows, lambda r: F.struct(_get(r, "$.node_id", "string").alias("k"), F.coalesce(_get(r, "$.score", "double"), F.lit(0.0)).alias("v"))), lambda p: F.coalesce(p.k, F.lit("")) != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.k == p.k))
    return F.map_from_entries(last)
