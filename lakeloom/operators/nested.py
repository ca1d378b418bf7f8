"""Problem 1: nested records become flat tables that keep parent-child links.

Each text is parsed once, in Arrow batches, into the levels of its tree. A higher-order SQL
expression then walks the levels inside the row, without a shuffle: nested transform calls give
every container the keys and indices of its ancestors and the nearest enclosing child object,
flatten joins the levels, and one inline per target table emits its rows.

Defined results: a null, empty or damaged text has no rows; a row without a record id keeps a
null record_id; an empty table gives an empty table; texts may be nested to any depth. Other columns
of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.functions.payloads import is_readable
from lakeloom.functions.runtime import cut
from lakeloom.functions.skeletons import skeletons_of_bodies, skeletons_of_texts

#: Keys whose value is a collection, so that a single object there is element 0.
COLLECTION_FIELDS = (
    "tags", "pages", "frames", "chapters", "revisions", "blocks", "children", "annotations", "replies", "reactions", "variants",
    "crops", "notes", "versions", "pools", "comments", "flags", "filters", "terms", "mentions", "mirrors",
)

_PLACED = "struct<path:string,scope:string,parent:string,field:string,digits:boolean,values:map<string,string>>"


def child_objects(skeleton: str, fields: tuple[str, ...] = COLLECTION_FIELDS) -> str:
    """SQL expression over a skeleton column: its child objects as an array of structs (path,
    scope, parent, field, digits, values); parent is the path of the enclosing child object."""
    names = "array(" + ", ".join(f"'{x}'" for x in fields) + ")"
    # c: a container with u, its parent; own: what makes it a child object ('' or '[0]' of its path), or null
    joined = "transform(level, c -> named_struct('c', c, 'u', get(element_at(acc, -1), c.up)))"
    stepped = f"""transform({joined}, e -> named_struct('c', e.c, 'u', e.u,
        'path', IF(e.c.idx IS NULL, concat(e.u.path, '.', e.c.key), concat(e.u.path, '[', e.c.idx, ']')),
        'own', CASE WHEN NOT e.c.obj THEN NULL WHEN e.c.idx IS NOT NULL OR e.u.digits THEN '' WHEN array_contains({names}, e.c.key) THEN '[0]' END))"""
    placed = f"""transform({stepped}, e -> named_struct('path', concat(e.path, coalesce(e.own, '')), 'scope', IF(e.own IS NULL, e.u.scope, concat(e.path, e.own)),
        'parent', IF(e.own IS NULL, NULL, e.u.scope), 'field', IF(e.c.idx IS NOT NULL OR e.u.digits, e.u.field, e.c.key), 'digits', e.c.digits, 'values', e.c.values))"""
    root = "transform(get(skeleton, 0), c -> named_struct('path', '$', 'scope', '$', 'parent', CAST(NULL AS string), 'field', '', 'digits', c.digits, 'values', c.values))"
    walk = f"""concat(coalesce(aggregate(slice(skeleton, 2, greatest(size(skeleton), 1)), CAST(array({root}) AS array<array<{_PLACED}>>),
        (acc, level) -> concat(acc, CAST(array({placed}) AS array<array<{_PLACED}>>)),
        acc -> filter(flatten(acc), x -> x.parent IS NOT NULL)), array()), CAST(deep AS array<{_PLACED}>))"""
    return walk.replace("skeleton", f"{skeleton}.levels").replace("(deep AS", f"({skeleton}.deep AS")


def walked(records: DataFrame, keep: list[str], skeleton: str, fields: tuple[str, ...] = COLLECTION_FIELDS) -> DataFrame:
    """(keep..., nodes): every record's child objects as one array, from a single walk."""
    return records.select(*keep, F.expr(child_objects(f"`{skeleton}`", fields)).alias("nodes"))


def emit(records: DataFrame, keep: list[str], only: str | None = None, members: dict[str, str] | None = None) -> DataFrame:
    """One row per child object of walked records, by one inline: the keep columns, node_path, parent_path
    and field (the collection it lies in); only: of one collection. members: columns taken from the
    object's scalar members by name, else all of them as the map values."""
    nodes = "nodes" if only is None else f"filter(nodes, x -> x.field = '{only}')"
    own = "x.values AS values" if members is None else ", ".join(f"x.values['{k}'] AS `{c}`" for c, k in members.items())
    # of a plain inline the optimizer would infer filters that evaluate the whole walk again
    rows = records.select(*keep, F.expr(f"inline_outer(transform({nodes}, x -> struct(x.path AS node_path, x.parent AS parent_path, x.field AS field{', ' + own if own else ''})))"))
    return rows.where(F.col("node_path").isNotNull())


def flatten_skeletons(records: DataFrame, keep: list[str], skeleton: str, fields: tuple[str, ...] = COLLECTION_FIELDS, only: str | None = None) -> DataFrame:
    """The child objects of skeletons as rows: walked, then emitted."""
    return emit(walked(records, keep, skeleton, fields), keep, only)


def flat_tables(records: DataFrame, keep: list[str], skeleton: str, tables: dict[str, dict[str, str]], fields: tuple[str, ...] = COLLECTION_FIELDS) -> dict[str, DataFrame]:
    """One flat table per collection, {collection: {column: member}}, all from one walk: its result is
    written once to the checkpoint folder, and each table is one inline over it. Tables are linked by the
    keep columns with node_path and parent_path."""
    nodes = walked(records, keep, skeleton, fields)
    nodes = cut(nodes) if len(tables) > 1 else nodes
    return {name: emit(nodes, keep, name, members).drop("field") for name, members in tables.items()}


def flatten_records(records: DataFrame, keep: list[str], text: str, fields: tuple[str, ...] = COLLECTION_FIELDS, values: bool = True, only: str | None = None) -> DataFrame:
    """flatten_skeletons of a column of JSON texts."""
    return flatten_skeletons(records.select(*keep, skeletons_of_texts(values, fields)(F.col(text)).alias("skeleton")), keep, "skeleton", fields, only)


def best_captures(captures: DataFrame) -> DataFrame:
    """(capture_id, request_json, raw): each capture once, raw from a readable row of it, or null.

    The request comes from a readable row if there is one. The shuffle carries bodies as they are
    stored, compressed, and only readable ones.
    """
    ok = is_readable("raw_zlib", "raw_bytes", "raw_sha256")
    rows = captures.select("capture_id", "request_json", "raw_zlib", "raw_bytes", "raw_sha256", ok.alias("ok"))
    return rows.groupBy("capture_id").agg(
        F.max(F.when(F.col("ok"), F.struct("raw_sha256", "raw_bytes", "raw_zlib"))).alias("raw"),
        F.max(F.struct("ok", "request_json")).getField("request_json").alias("request_json"),
    )


def best_items(items: DataFrame) -> DataFrame:
    """(record_id, record_json): each item's row with the most attempts, of equal ones the greatest
    text; a null count is the least, a null part of the key is empty in record_id."""
    best = items.groupBy("job_id", "post_id").agg(F.max(F.struct("attempts", "record_json")).getField("record_json").alias("record_json"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return best.select(F.concat(part("job_id"), F.lit("/"), part("post_id")).alias("record_id"), "record_json")


def _of(field: str, skeleton: Column, record: str) -> list[Column]:
    return [F.lit(field).alias("source_field"), F.col(record).alias("record_id"), skeleton.alias("skeleton")]


def all_skeletons(spark: SparkSession, sf_dir: str, values: bool = True) -> DataFrame:
    """(source_field, record_id, skeleton) of all captures and items."""
    captures = best_captures(spark.read.parquet(f"{sf_dir}/captures.parquet"))
    body = skeletons_of_bodies(values, COLLECTION_FIELDS)(F.col("raw.raw_zlib"), F.col("raw.raw_bytes"), F.col("raw.raw_sha256"))
    both = captures.select("capture_id", body.alias("body"), skeletons_of_texts(values, COLLECTION_FIELDS)(F.col("request_json")).alias("request"))
    both = both.selectExpr("stack(2, 'captures.raw_zlib', capture_id, body, 'captures.request_json', capture_id, request) AS (source_field, record_id, skeleton)")
    items = best_items(spark.read.parquet(f"{sf_dir}/items.parquet")).select(*_of("items.record_json", skeletons_of_texts(values, COLLECTION_FIELDS)(F.col("record_json")), "record_id"))
    return both.union(items)


#: What the flat tables hold of each object beside its keys.
TABLES = {
    "comments": {"comment_id": "id", "text": "text"},
    "pages": {"page_id": "id", "width": "width", "height": "height", "url": "url"},
    "terms": {"term_id": "id", "name": "name"},
    "tags": {"tag_id": "id", "name": "name"},
}
_KEEP = ["source_field", "record_id"]


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Flat tables of all captures and items."""
    return flat_tables(all_skeletons(spark, sf_dir), _KEEP, "skeleton", {n: TABLES[n] for n in names})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = walked(all_skeletons(spark, sf_dir, values=False), _KEEP, "skeleton")
    return emit(nodes, _KEEP, members={}).select(*_KEEP, "node_path", "parent_path")


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the flat tables hang together: objects of each table and of each table that they lie in."""
    of = tables(spark, sf_dir, list(TABLES))
    keys = [t.select(F.lit(n).alias("name"), *_KEEP, "node_path", "parent_path") for n, t in of.items()]
    every = keys[0].union(keys[1]).union(keys[2]).union(keys[3])
    up = every.select(F.col("name").alias("parent_name"), F.col("source_field").alias("__f"), F.col("record_id").alias("__r"), F.col("node_path").alias("__p"))
    same = (F.col("source_field") == F.col("__f")) & F.col("record_id").eqNullSafe(F.col("__r")) & (F.col("parent_path") == F.col("__p"))
    return every.join(up, same, "left").groupBy("name", "parent_name").agg(F.count("*").alias("n"))
