"""Problem 3: schemas that drift between files, matched by similarity flooding.

Every version of a lineage is a tree of fields. For each two consecutive versions all pairs of fields
on the same level form a pairwise connectivity graph, joined by the edges of both trees: parent to
child, list to element, field to type. Initial scores come from the evidence (name, field id, alias,
normalised name; without any, a little for the same type) and are propagated over the graph until they
converge. A pair's score is its evidence and what reaches it from its surroundings, which can't outweigh
a stronger kind of evidence, as the order of kinds is given; level by level below the pairs already
selected, pairs with some evidence are taken in the order of their scores, each field once. Selected
pairs are compared for changes of type, what is left was removed or added.

A lineage's versions are one group (tens of schemas, thousands of fields: bounded by what people
write, not by the data). Data is only touched by aggregations: the first use of each version, and
the keys and types of payloads, reduced within each task before the shuffle.

Defined results: unreadable and unused schemas and those without a lineage are left out; repeated
schema rows count once; a version whose uses have no order comes last; null and damaged payloads
have no fields; empty tables give an empty report.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeloom.functions.payloads import body_text, inflate_checked, is_readable
from lakeloom.functions.runtime import cut
from lakeloom.functions.skeletons import parse

#: Kinds of evidence in the order in which they're tried, with the similarity they start from.
EVIDENCE = ("name", "id", "alias", "normal")
START = {"name": 1.0, "id": 0.8, "alias": 0.6, "normal": 0.4}
#: Start of pairs without evidence but of one type, and the share of a score that propagation makes up:
#: less than the distance between two kinds of evidence.
ALIKE, SHARE = 0.05, 0.19
#: Propagation ends when no score moves by more than EPSILON; after ROUNDS it's taken as faulty.
EPSILON, ROUNDS = 1e-4, 10_000


# --- trees: {"name", "id", "aliases", "type", "fields" | "element"} -------------------------------


def tree_of_arrow(name: str, t: pa.DataType, meta: dict[bytes, bytes] | None) -> dict:
    """The tree of one Arrow field; dictionaries are their values, large and view types plain ones."""
    meta = meta or {}
    if pa.types.is_dictionary(t):
        return tree_of_arrow(name, t.value_type, meta)
    try:
        aliases = [x for x in json.loads(meta.get(b"aliases", b"[]")) if isinstance(x, str)]
    except (ValueError, TypeError):
        aliases = []
    fid = meta.get(b"PARQUET:field_id")
    node = {"name": name, "id": fid.decode("utf-8", "replace") if fid is not None else None, "aliases": aliases}
    if pa.types.is_struct(t):
        return node | {"type": "struct", "fields": [tree_of_arrow(f.name, f.type, f.metadata) for f in t]}
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return node | {"type": "list", "element": tree_of_arrow("", t.value_type, t.value_field.metadata)}
    return node | {"type": re.sub(r"^(large_|)(string|binary)(_view|)$", r"\2", str(t))}


def read_schema(data: bytes | None) -> tuple[str, list[dict]] | None:
    """(lineage, fields) of an Arrow IPC schema message; None if it can't be read or names none."""
    if data is None:
        return None
    try:
        s = pa.ipc.read_schema(pa.BufferReader(data))
        key = (s.metadata or {}).get(b"source_key")
        return None if key is None else (key.decode(), [tree_of_arrow(f.name, f.type, f.metadata) for f in s])
    except (pa.ArrowException, OSError, ValueError):
        return None


def normal(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


# --- similarity flooding -------------------------------------------------------------------------


def evidence(a: dict, b: dict, kinds: tuple[str, ...]) -> str | None:
    """The strongest evidence that a (old) and b (new) are one field."""
    for kind in kinds:
        if kind == "name" and a["name"] == b["name"]:
            return kind
        if kind == "id" and a["id"] is not None and a["id"] == b["id"]:
            return kind
        if kind == "alias" and a["name"] in b["aliases"]:
            return kind
        if kind == "normal" and normal(a["name"]) and normal(a["name"]) == normal(b["name"]):
            return kind
    return None


def candidates(old: list[dict], new: list[dict], kinds: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Pairs of fields with any evidence, found by hashing each kind of it."""
    pairs = set()
    for own, other in (
        (lambda f: [f["name"]], lambda f: [f["name"]]), (lambda f: [f["id"]] if f["id"] is not None else [], lambda f: [f["id"]] if f["id"] is not None else []),
        (lambda f: [f["name"]], lambda f: f["aliases"]), (lambda f: [normal(f["name"])], lambda f: [normal(f["name"])]),
    ):
        where: dict[str, list[int]] = {}
        for j, f in enumerate(new):
            for x in other(f):
                where.setdefault(x, []).append(j)
        pairs |= {(i, j) for i, f in enumerate(old) for x in own(f) for j in where.get(x, [])}
    return [(i, j, kind) for i, j in sorted(pairs) if (kind := evidence(old[i], new[j], kinds))]


class Flooding:
    """The pairwise connectivity graph of two field lists and its scores."""

    def __init__(self, old: list[dict], new: list[dict], kinds: tuple[str, ...]) -> None:
        self.kinds = kinds
        self.start: list[float] = []
        self.edges: list[tuple[int, int, str]] = []
        self.node: dict[tuple, int] = {}
        self.types: dict[tuple[str, str], int] = {}
        root = self._add(("root",), 1.0)
        self._level(root, old, new, ("root",))
        self.scores = self._flood()

    def _add(self, key: tuple, start: float) -> int:
        self.node[key] = len(self.start)
        self.start.append(start)
        return self.node[key]

    def _level(self, up: int, old: list[dict], new: list[dict], key: tuple) -> None:
        evident = {(i, j): START[kind] for i, j, kind in candidates(old, new, self.kinds)}
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                start = evident.get((i, j))
                n = self._add((*key, i, j), start if start is not None else ALIKE if a["type"] == b["type"] else 0.0)
                self.edges.append((up, n, "child"))
                self._typed(n, a, b, (*key, i, j))

    def _typed(self, n: int, a: dict, b: dict, key: tuple) -> None:
        names = (a["type"], b["type"])
        if names not in self.types:
            self.types[names] = self._add(("type", *names), 1.0 if names[0] == names[1] else 0.0)
        self.edges.append((n, self.types[names], "type"))
        if a["type"] == b["type"] == "struct":
            self._level(n, a["fields"], b["fields"], key)
        elif a["type"] == b["type"] == "list":
            e = self._add((*key, "[]"), 0.5)
            self.edges.append((n, e, "element"))
            self._typed(e, a["element"], b["element"], (*key, "[]"))

    def _flood(self) -> np.ndarray:
        """Fixpoint of s = normalised(s0 + s + flow(s0 + s)); a label's edges at a node share weight 1."""
        s0 = np.array(self.start)
        if not self.edges:
            return s0
        a, b = (np.array([e[k] for e in self.edges]) for k in (0, 1))
        label = np.array([{"child": 0, "type": 1, "element": 2}[e[2]] for e in self.edges])
        out, into = a * 3 + label, b * 3 + label
        forth, back = 1.0 / np.bincount(out)[out], 1.0 / np.bincount(into)[into]
        s = s0
        for _ in range(ROUNDS):
            base = s0 + s
            flow = np.bincount(b, base[a] * forth, len(s0)) + np.bincount(a, base[b] * back, len(s0))
            after = (base + flow) / (base + flow).max()
            if np.abs(after - s).max() < EPSILON:
                return after
            s = after
        raise RuntimeError("the scores didn't settle")

    def select(self, old: list[dict], new: list[dict], key: tuple) -> list[tuple[int, int, str]]:
        """One-to-one pairs of this level with some evidence, in the order of their scores, then of fields."""
        ranked = sorted((-(START[kind] + SHARE * self.scores[self.node[(*key, i, j)]]), i, j, kind) for i, j, kind in candidates(old, new, self.kinds))
        left, right, chosen = set(), set(), []
        for _, i, j, kind in ranked:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                chosen.append((i, j, kind))
        return sorted(chosen)


def compare(old: list[dict], new: list[dict], kinds: tuple[str, ...]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(changes, correspondences) between two versions: (change, path before, path after) and the
    paths of every selected pair."""
    flood = Flooding(old, new, kinds)
    changes: list[tuple[str, str, str]] = []
    pairs: list[tuple[str, str]] = []

    def level(a: list[dict], b: list[dict], key: tuple, pa_: str, pb: str) -> None:
        chosen = flood.select(a, b, key)
        for i, j, kind in chosen:
            x, y = pa_ + a[i]["name"], pb + b[j]["name"]
            pairs.append((x, y))
            if kind != "name":
                changes.append(("renamed", x, y))
            typed(a[i], b[j], (*key, i, j), x, y)
        for i in sorted(set(range(len(a))) - {c[0] for c in chosen}):
            changes.append(("removed", pa_ + a[i]["name"], ""))
        for j in sorted(set(range(len(b))) - {c[1] for c in chosen}):
            changes.append(("added", "", pb + b[j]["name"]))

    def typed(a: dict, b: dict, key: tuple, x: str, y: str) -> None:
        if a["type"] == b["type"] == "struct":
            level(a["fields"], b["fields"], key, x + ".", y + ".")
        elif a["type"] == b["type"] == "list":
            typed(a["element"], b["element"], (*key, "[]"), x + "[]", y + "[]")
        elif isinstance(a["type"], str) and a["type"].startswith("{") and "{}" in (a["type"], b["type"]):
            pass  # a set of types without any value says nothing
        elif a["type"] != b["type"]:
            changes.append(("retyped", x, y))

    level(old, new, ("root",), "", "")
    return changes, pairs


# --- versions ------------------------------------------------------------------------------------


def schema_versions(schemas: DataFrame, uses: DataFrame) -> DataFrame:
    """(lineage, version, rank, kinds, tree) of the readable schemas that uses names; ordered by rank."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *found) for i, data in zip(b["source_schema_id"], b["schema_ipc"]) if (found := read_schema(data))]
            yield pd.DataFrame([(key, i, json.dumps(tree)) for i, key, tree in rows], columns=["lineage", "version", "tree"])

    first = uses.where("source_schema_id IS NOT NULL").groupBy(F.col("source_schema_id").alias("version")).agg(F.min("raw_row").alias("first"))
    read_ = schemas.where("source_schema_id IS NOT NULL").select("source_schema_id", "schema_ipc").distinct().mapInPandas(read, "lineage string, version string, tree string")
    read_ = read_.groupBy("version").agg(F.min(F.struct("lineage", "tree")).alias("s")).select("version", "s.*")
    return read_.join(first, "version").select("lineage", "version", F.coalesce("first", F.lit(2**63 - 1)).alias("rank"), F.lit("name,id,alias,normal").alias("kinds"), "tree")


def _value_type(v: object) -> str | None:
    if v is None or (isinstance(v, (dict, list)) and not v):
        return None
    return "boolean" if isinstance(v, bool) else "nested" if isinstance(v, (dict, list)) else "string" if isinstance(v, str) else "number"


def payloads(v: object) -> Iterator[tuple[int, dict]]:
    """The payloads of a capture's body with their positions."""
    if isinstance(v, dict):
        payload = v["body"] if v.get("body") is not None else (v.get("resource_response") or {}).get("data") if isinstance(v.get("resource_response") or {}, dict) else None
        yield from ((k, p) for k, p in enumerate(payload if isinstance(payload, list) else [payload]) if isinstance(p, dict))


def payload_keys(v: object) -> Iterator[tuple[str, str | None]]:
    """The own keys of the payloads of a capture's body, with the types of their values."""
    for _, p in payloads(v):
        yield from ((k, _value_type(x)) for k, x in p.items())


#: Captures whose payloads count, if they can be read.
GOOD = "http_status = 200 AND source_error IS NULL AND raw_format = 'json' AND endpoint IS NOT NULL AND adapter_version IS NOT NULL"


def capture_payloads(captures: DataFrame) -> DataFrame:
    """(capture_id, element, lineage, version, text) of the payloads of readable good captures, each
    capture once: of several readable rows the one with the least hash."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, k, f"captures:{e}", v, json.dumps(p, ensure_ascii=False)) for c, e, v, data in zip(b["capture_id"], b["endpoint"], b["adapter_version"], b["raw_zlib"]) for k, p in payloads(parse(body_text(zlib.decompress(data))))]
            yield pd.DataFrame(rows, columns=["capture_id", "element", "lineage", "version", "text"])

    readable = captures.where(GOOD).where(is_readable("raw_zlib", "raw_bytes", "raw_sha256"))
    once = readable.groupBy("capture_id").agg(F.min(F.struct("raw_sha256", "endpoint", "adapter_version", "raw_zlib")).alias("c")).select("capture_id", "c.*")
    return once.mapInPandas(read, "capture_id string, element int, lineage string, version string, text string")


def capture_versions(captures: DataFrame) -> DataFrame:
    """(lineage, version, rank, kinds, tree) of the payloads of readable good captures by endpoint."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple] = set()  # bounded by the distinct keys of payloads
        for b in batches:
            for endpoint, version, data, size, digest in zip(b["endpoint"], b["adapter_version"], b["raw_zlib"], b["raw_bytes"], b["raw_sha256"]):
                body = inflate_checked(data, size, digest)
                if body is not None:
                    found.add((endpoint, version, None, None))
                    found.update((endpoint, version, *x) for x in payload_keys(parse(body_text(body))))
        yield pd.DataFrame(sorted(found, key=str), columns=["endpoint", "version", "key", "type"])

    rows = captures.where(GOOD).select("endpoint", "adapter_version", "raw_zlib", "raw_bytes", "raw_sha256").mapInPandas(keys, "endpoint string, version string, key string, type string")
    fields = rows.groupBy("endpoint", "version", "key").agg(F.array_sort(F.collect_set("type")).alias("types"))
    named = F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("name"), F.concat(F.lit("{"), F.array_join("types", ","), F.lit("}")).alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("id")))
    trees = fields.groupBy("endpoint", "version").agg(F.to_json(F.array_sort(F.collect_list(named)), {"ignoreNullFields": "false"}).alias("tree"))
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(version, '([0-9]+)$', 1), '') AS bigint)"), F.lit(-1).cast("long"))
    return trees.select(F.concat(F.lit("captures:"), F.col("endpoint")).alias("lineage"), "version", number.alias("rank"), F.lit("name,normal").alias("kinds"), "tree")


def nested_levels(tree: list[dict], path: str = "", top: bool = True) -> Iterator[list[str]]:
    """The paths of the fields of every struct below the top level, struct by struct."""
    if not top:
        yield [path + f["name"] for f in tree]
    for f in tree:
        here, node = path + f["name"], f
        while node["type"] == "list":
            here, node = here + "[]", node["element"]
        if node["type"] == "struct":
            yield from nested_levels(node["fields"], here + ".", False)


def renamed_text(text: str | None, names: dict[str, str]) -> str | None:
    """A JSON object with the keys below its top level renamed by path; text that is no object stays."""
    v = parse(text)
    if not isinstance(v, dict):
        return text

    def walk(x: object, path: str) -> object:
        if isinstance(x, list):
            return [walk(y, path + "[]") for y in x]
        if isinstance(x, dict):
            return {names.get(f"{path}.{k}", k) if path else k: walk(y, f"{path}.{k}" if path else k) for k, y in x.items()}
        return x

    return json.dumps(walk(v, ""), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _with_names(text: pd.Series, names: pd.Series) -> pd.Series:
    """renamed_text by a JSON object of paths; without one the text as it is."""
    maps = {n: json.loads(n) for n in names.dropna().unique()}
    return pd.Series([t if n is None or t is None else renamed_text(t, maps[n]) for t, n in zip(text, names)], dtype=object)


def _per_lineage(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "version"], kind="stable")
        trees = [json.loads(t) for t in pdf["tree"]]
        versions, lineage, kinds = list(pdf["version"]), pdf["lineage"].iloc[0], tuple(pdf["kinds"].iloc[0].split(","))
        out: list[tuple] = []
        if kind == "changes":
            for k in range(1, len(trees)):
                out += [(lineage, versions[k - 1], versions[k], c, x, y) for c, x, y in compare(trees[k - 1], trees[k], kinds)[0]]
            return pd.DataFrame(out, columns=["lineage", "from_version", "to_version", "change", "field_from", "field_to"])
        # names: what each version calls the fields of the consistent table, which are named as in the last
        # version that has them; below the top level (step -1) only names that differ
        latest: dict[str, str] = {}
        below: dict[str, str] = {}
        for k in range(len(trees) - 1, -1, -1):
            after = dict(compare(trees[k], trees[k + 1], kinds)[1]) if k + 1 < len(trees) else {}
            now: dict[str, str] = {}
            for f in trees[k]:  # SQL's column names don't tell case apart
                column = latest.get(after.get(f["name"], ""), f["name"].lower())
                while column in now.values():
                    column += "_"
                now[f["name"]] = column
            out += [(lineage, versions[k], k, name, column, next(f["type"] for f in trees[k] if f["name"] == name)) for name, column in now.items()]
            latest = now
            names: dict[str, str] = {}
            for level in nested_levels(trees[k]):
                taken: set[str] = set()
                for path in sorted(level, key=lambda x: after.get(x) not in below):  # matched fields first
                    name = below.get(after.get(path, ""), re.split(r"\.|\[\]", path)[-1])
                    while name in taken:
                        name += "_"
                    taken.add(name)
                    names[path] = name
            out += [(lineage, versions[k], -1, path, name, "") for path, name in names.items() if re.split(r"\.|\[\]", path)[-1] != name]
            below = names
        return pd.DataFrame(out, columns=["lineage", "version", "step", "field", "column", "type"])

    return run


def schema_changes(versions: DataFrame) -> DataFrame:
    """(lineage, from_version, to_version, change, field_from, field_to) between consecutive versions."""
    return versions.groupBy("lineage").applyInPandas(_per_lineage("changes"), "lineage string, from_version string, to_version string, change string, field_from string, field_to string")


def consistent_names(versions: DataFrame) -> DataFrame:
    """(lineage, version, step, field, column, type): the column of the consistent table that holds
    each top-level field of each version, and with step -1 the consistent name of each field below, by its
    path, where it differs from the field's own."""
    return versions.groupBy("lineage").applyInPandas(_per_lineage("names"), "lineage string, version string, step int, field string, column string, type string")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return schema_versions(spark.read.parquet(f"{d}/source_schemas.parquet"), spark.read.parquet(f"{d}/raw_metadata.parquet").select("source_schema_id", "raw_row"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(_versions(spark, d).union(capture_versions(spark.read.parquet(f"{d}/captures.parquet")))).distinct()


#: SQL types for the Arrow types that a column of the consistent table may have.
_SQL_TYPES = {"bool": "boolean", "int8": "bigint", "int16": "bigint", "int32": "bigint", "int64": "bigint", "uint8": "bigint", "uint16": "bigint", "uint32": "bigint", "float": "double", "double": "double"}
#: Types of JSON values that each of them holds as they are.
_HELD = {"boolean": "BOOLEAN", "bigint": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*"}


def unified(records: DataFrame, versions: DataFrame, version: str, text: str, keep: list[str], lineage: str | None = None) -> DataFrame:
    """All records in one table: keep, lineage, one column per consistent field of any lineage, and rest.

    A column has the type that all versions of all lineages agree on, else text; nested values are JSON
    text, in which fields have the names of the last version too. rest is a JSON object, null if empty, of what no column holds: values that a column's type
    can't hold as they are, fields that the record's version doesn't name (for an unknown version all of
    them), and under '$' a text that isn't a JSON object. The schemas (a bounded set) are collected to
    name the columns; each record finds its names by a join on its version, and, where lineage names a
    column of the records that isn't null, on that too (versions of captures have the same names in
    many lineages). A set of types without any value has no say."""
    every = cut(consistent_names(versions))  # a row per field of each version
    names, deeper = every.where("step >= 0"), every.where("step < 0")
    plan = names.groupBy("column").agg(F.collect_set(F.when(F.col("type") != "{}", F.col("type"))).alias("types")).collect()
    own = names.groupBy(F.col("version").alias("__v"), "lineage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "field")))).alias("__names"))
    nested = deeper.groupBy(F.col("version").alias("__v"), "lineage").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "column"))))).alias("__nested"))
    own = own.join(nested, ["__v", "lineage"], "left")
    same = records[version] == own["__v"]
    if lineage is not None:
        captured = F.when(own["lineage"].startswith("captures:"), own["lineage"])
        same = same & (F.coalesce(records[lineage], F.lit("")) == F.coalesce(captured, F.lit("")))
    rows = records.join(own, same, "left").drop(*([records[lineage]] if lineage is not None else []))
    # a text with repeated keys is no variant; written again it has the last one of them
    again = F.coalesce(F.col("__nested"), F.expr(f"IF(`{text}` IS NOT NULL AND try_parse_json(`{text}`) IS NULL, '{{}}', NULL)"))
    rows = rows.select(*keep, "lineage", "__names", F.col(text).alias("__text"), _with_names(F.col(text), again).alias("__named"))
    rows = rows.select(*keep, "lineage", "__names", F.expr("try_variant_get(try_parse_json(__named), '$', 'map<string,variant>')").alias("__m"), "__text")
    cols, unfit = [], []
    for name, types in sorted((r[0], set(r[1])) for r in plan):
        kinds = {_SQL_TYPES.get(t, "string") for t in types}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        safe = name.replace("`", "").replace("'", "")
        value = f"try_element_at(__m, __names['{safe}'])"
        cast = f"try_variant_get({value}, '$', '{kind}')"
        if kind != "string":
            fits = f"({cast} IS NOT NULL AND (schema_of_variant({value}) RLIKE '^({_HELD[kind]})$' OR try_variant_get({value}, '$', 'string') = CAST({cast} AS STRING)))"
            unfit.append(f"IF({fits}, NULL, __names['{safe}'])")
            cast = f"IF({fits}, {cast}, NULL)"
        cols.append(F.expr(f"{cast} AS `f_{safe}`"))
    known = "coalesce(array_except(map_values(__names), __unfit), CAST(array() AS array<string>))"
    left = f"map_filter(__m, (k, v) -> NOT is_variant_null(v) AND NOT array_contains({known}, k))"
    rest = f"CASE WHEN __m IS NULL THEN to_json(map('$', __text)) WHEN size({left}) > 0 THEN to_json({left}) END"
    rows = rows.withColumn("__unfit", F.expr(f"array({', '.join(unfit) or 'CAST(NULL AS STRING)'})"))
    return rows.select(*keep, "lineage", *cols, F.when(F.col("__text").isNotNull(), F.expr(rest)).alias("rest"))


def p3_exports(spark: SparkSession, d: str) -> DataFrame:
    records = spark.read.parquet(f"{d}/raw_metadata.parquet").distinct()
    return unified(records, _versions(spark, d), "source_schema_id", "source_metadata_json", ["raw_row", "observation_id", "source_schema_id"])


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """The exports' records and the captures' payloads in one table; record_id is the raw_row or the
    capture_id, element the payload's position in its capture."""
    captures = spark.read.parquet(f"{d}/captures.parquet")
    raw = spark.read.parquet(f"{d}/raw_metadata.parquet").distinct()
    exports = raw.select(F.col("raw_row").cast("string").alias("record_id"), F.lit(None).cast("int").alias("element"), "observation_id", F.lit(None).cast("string").alias("captured"), F.col("source_schema_id").alias("version"), F.col("source_metadata_json").alias("text"))
    found = capture_payloads(captures).select(F.col("capture_id").alias("record_id"), "element", F.lit(None).cast("string").alias("observation_id"), F.col("lineage").alias("captured"), "version", "text")
    versions = _versions(spark, d).union(capture_versions(captures))
    return unified(exports.unionByName(found), versions, "version", "text", ["record_id", "element", "observation_id", "version"], "captured")
