"""Declarative queries over the lake: typed conditions, checked, normalised and compiled to plans.

A spec is a conjunction of conditions and a rule that says which observation they're about: the
current one of each post, or any single one. compile_spec gives the set of objects (or keys) as one
lazy plan: predicates on objects and on observations are kept apart, every EXISTS is a semi join,
an OR of two join rules is a union of two equi-joins, and the only distinct is on the key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.sources.lake import Lake

RULES = ("current_post", "any_observation")
MAX_SOURCES, MAX_CONDITIONS, MAX_LIST, MAX_TEXT = 8, 12, 64, 256
_COMPARE = ("eq", "ne", "gte", "lte")
_NULL = ("is_missing", "is_present")
OPERATORS = {
    "text": ("eq", "ne", "in", *_NULL),
    "integer": (*_COMPARE, *_NULL),
    "boolean": ("eq", "ne", *_NULL),
    "tags": ("has_tag", "has_all_tags", "has_any_tags", "has_no_tags", *_NULL),
}


class SpecError(ValueError):
    """A spec that can't be normalised or that the field directory doesn't allow."""


@dataclass(frozen=True)
class Field:
    """A queryable field: its type, on which side it lies, and its column."""

    type: str
    side: str
    column: Callable[[], Column]
    unit: str = ""
    sortable: bool = False


def lake_fields() -> dict[str, Field]:
    """The field directory of a tagged lake."""
    return {
        "asset.id": Field("text", "object", lambda: F.col("sha256"), sortable=True),
        "stored.length": Field("integer", "object", lambda: F.col("length"), "bytes"),
        "stored.extension": Field("text", "object", lambda: F.col("stored_ext")),
        "post.id": Field("integer", "observation", lambda: F.col("post_id"), sortable=True),
        "post.rating": Field("text", "observation", lambda: F.col("rating")),
        "post.score": Field("integer", "observation", lambda: F.col("score")),
        "image.width": Field("integer", "observation", lambda: F.col("width"), "pixels"),
        "post.tags": Field("tags", "observation", lambda: F.col("tag_string")),
        "post.deleted": Field("boolean", "observation", lambda: F.col("is_deleted")),
    }


def json_field(path: str, column: str = "props", kind: str = "integer") -> Field:
    """A field at a JSON path of an observation column; a value that isn't of the type is missing."""
    cast = {"integer": "bigint", "text": "string", "boolean": "boolean"}[kind]
    return Field(kind, "observation", lambda: F.get_json_object(column, path).try_cast(cast))


@dataclass(frozen=True, order=True)
class Condition:
    field: str
    op: str
    value: tuple[str, ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    rule: str
    conditions: tuple[Condition, ...] = ()
    sources: tuple[str, ...] = field(default=("lake",))

    def normalised(self, fields: dict[str, Field]) -> QuerySpec:
        """Conditions and lists sorted without repeats; SpecError if anything isn't allowed."""
        if self.rule not in RULES:
            raise SpecError(f"rule {self.rule}")
        if not 1 <= len(set(self.sources)) <= MAX_SOURCES:
            raise SpecError("number of sources")
        out = set()
        for c in self.conditions:
            f = fields.get(c.field)
            if f is None or c.op not in OPERATORS[f.type] and not (f.side == "object" and f.type == "text" and c.op in _COMPARE):
                raise SpecError(f"{c.field} {c.op}")
            values = tuple(sorted(set(c.value))) if c.op in ("in", "has_all_tags", "has_any_tags", "has_no_tags") else c.value
            many = c.op in ("in", "has_all_tags", "has_any_tags", "has_no_tags")
            if len(values) > MAX_LIST or any(len(v) > MAX_TEXT for v in values) or len(values) != (0 if c.op in _NULL else 1) and not (many and values):
                raise SpecError(f"values of {c.field}")
            if f.type == "integer" and any(not _canonical(v) for v in values) or f.type == "boolean" and any(v not in ("true", "false") for v in values):
                raise SpecError(f"values of {c.field}")
            if f.type == "tags" and any(not v or " " in v for v in values):
                raise SpecError(f"tags of {c.field}")
            out.add(Condition(c.field, c.op, values))
        if len(out) > MAX_CONDITIONS:
            raise SpecError("number of conditions")
        return QuerySpec(self.rule, tuple(sorted(out)), tuple(sorted(set(self.sources))))

    def fingerprint(self) -> str:
        """A hash of the family: the same for any order of conditions and any sources."""
        plain = {"rule": self.rule, "conditions": sorted([c.field, c.op, *c.value] for c in self.conditions)}
        return hashlib.sha256(json.dumps(plain, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def impossible(self) -> bool:
        """Whether the conditions contradict each other, so that no plan is needed."""
        wanted, banned = set(), set()
        for c in self.conditions:
            wanted |= set(c.value) if c.op in ("has_tag", "has_all_tags") else set()
            banned |= set(c.value) if c.op == "has_no_tags" else set()
        lists = [set(c.value) for c in self.conditions if c.op in ("in", "eq") and c.field == "post.rating"]
        return bool(wanted & banned) or (bool(lists) and not set.intersection(*lists))


def _canonical(v: str) -> bool:
    try:
        return str(int(v)) == v and -(2**63) <= int(v) < 2**63
    except ValueError:
        return False


def predicate(f: Field, c: Condition) -> Column:
    """The condition as a column; null (no match) where the field is missing, unless it asks for that."""
    col = f.column()
    if c.op in _NULL:
        return col.isNull() if c.op == "is_missing" else col.isNotNull()
    if f.type == "tags":
        tokens, wanted = F.split(col, " "), F.array(*[F.lit(v) for v in c.value])
        if c.op == "has_tag":
            return F.array_contains(tokens, c.value[0])
        if c.op == "has_all_tags":
            return reduce(lambda a, b: a & b, [F.array_contains(tokens, v) for v in c.value])
        overlap = F.arrays_overlap(tokens, wanted)
        return overlap if c.op == "has_any_tags" else ~overlap
    if c.op == "in":
        return col.isin(*c.value)
    v = F.lit(int(c.value[0])) if f.type == "integer" else F.lit(c.value[0] == "true") if f.type == "boolean" else F.lit(c.value[0])
    return {"eq": col == v, "ne": col != v, "gte": col >= v, "lte": col <= v}[c.op]


def compile_spec(spec: QuerySpec, lake: Lake, fields: dict[str, Field] | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(sha256) of the objects that match; changed: only of these objects (for a delta)."""
    fields = fields or lake_fields()
    spec = spec.normalised(fields)
    objects = lake.objects if changed is None else lake.objects.join(changed.select("sha256"), "sha256", "left_semi")
    if spec.impossible():
        return objects.select("sha256").limit(0)
    sides: dict[str, list[Column]] = {"object": [], "observation": []}
    for c in spec.conditions:
        sides[fields[c.field].side].append(predicate(fields[c.field], c))
    for p in sides["object"]:
        objects = objects.where(p)
    if not sides["observation"]:
        return objects.select("sha256").distinct()
    matching = reduce(lambda df, p: df.where(p), sides["observation"], lake.observations)  # all on the same observation
    if spec.rule == "current_post":
        rows = lake.current_posts.join(matching.select("row_id"), "row_id", "left_semi").select("asset_id")
        keys = lake.assets.join(rows, "asset_id", "left_semi").select("sha256")
    else:
        by_post = lake.assets.join(matching.where("post_id IS NOT NULL").select("post_id"), "post_id", "left_semi").select("sha256")
        by_row = lake.assets.join(matching.select("row_id"), "row_id", "left_semi").select("sha256")
        keys = by_post.unionByName(by_row)
    return objects.join(keys, "sha256", "left_semi").select("sha256").distinct()


def concat_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """(source_id, asset_id) of several sources' results (each with sha256)."""
    tagged = [df.select(F.lit(s).alias("source_id"), F.col("sha256").alias("asset_id")) for s, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, tagged)


def derived_filter(keys: DataFrame, column: DataFrame, key: str, op: str, value: int | None = None) -> DataFrame:
    """Keys whose scalar artifact column (key, status, value) compares as asked. is_missing matches the
    status missing only; a failed or uncomputed value matches nothing."""
    status = F.col("status")
    test = {"is_missing": status == "missing", "is_present": status == "available"}.get(op)
    if test is None:
        v = F.col("value")
        test = (status == "available") & {"eq": v == value, "ne": v != value, "gte": v >= value, "lte": v <= value}[op]
    return keys.join(column.where(test).select(key), key, "left_semi")
