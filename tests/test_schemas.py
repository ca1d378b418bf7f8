import brute_schemas
import pyarrow as pa
import pytest

from lakeloom.operators import schemas


def rows(duck, sql):
    return duck.sql(sql).fetchall()


def test_given_data_against_plain_rules(spark, data, duck):
    got = {tuple(r) for r in schemas.p3_found(spark, data).collect()}
    want = brute_schemas.changes(
        rows(duck, "select source_schema_id, schema_ipc from source_schemas"), rows(duck, "select raw_row, source_schema_id from raw_metadata"),
        rows(duck, "select endpoint, adapter_version, http_status, source_error, raw_format, raw_zlib, raw_bytes, raw_sha256 from captures"),
    )
    assert got == want and want


def field(name, t=pa.string(), **meta):
    return pa.field(name, t, metadata={k.replace("field_id", "PARQUET:field_id"): v for k, v in meta.items()})


def changes(old, new):
    trees = [[schemas.tree_of_arrow(f.name, f.type, f.metadata) for f in x] for x in (old, new)]
    return sorted(schemas.compare(*trees, schemas.EVIDENCE)[0])


@pytest.mark.parametrize(
    "old, new, want",
    [
        ([field("a"), field("b")], [field("b"), field("a")], []),
        ([field("a", field_id="1")], [field("x", field_id="1")], [("renamed", "a", "x")]),
        ([field("a", field_id="1"), field("b", field_id="2")], [field("a", field_id="2"), field("c", field_id="1")], [("added", "", "c"), ("removed", "b", "")]),
        ([field("old")], [field("new", aliases='["older", "old"]')], [("renamed", "old", "new")]),
        ([field("old")], [field("new", aliases="not json")], [("added", "", "new"), ("removed", "old", "")]),
        ([field("up_score")], [field("UpScore", pa.int64())], [("renamed", "up_score", "UpScore"), ("retyped", "up_score", "UpScore")]),
        ([field("a", pa.dictionary(pa.int32(), pa.string()))], [field("a", pa.large_string())], []),
        ([field("s", pa.struct([field("x"), field("y")]))], [field("s", pa.struct([field("X"), field("z")]))], [("added", "", "s.z"), ("removed", "s.y", ""), ("renamed", "s.x", "s.X")]),
        ([field("l", pa.list_(pa.struct([field("x", pa.int32())])))], [field("l", pa.list_(pa.struct([field("x", pa.int64())])))], [("retyped", "l[].x", "l[].x")]),
        ([field("l", pa.list_(pa.string()))], [field("l", pa.list_(pa.int64()))], [("retyped", "l[]", "l[]")]),
        ([field("s", pa.struct([field("x")]))], [field("s", pa.string())], [("retyped", "s", "s")]),
        ([field("s", pa.struct([field("x")]))], [], [("removed", "s", "")]),
        ([], [], []),
    ],
)
def test_rules(old, new, want):
    assert changes(old, new) == want


def test_ambiguous_names_follow_structure():
    old = [field("box", pa.struct([field("w", pa.int32()), field("h", pa.int32())]))]
    new = [field("Box", pa.string()), field("BOX", pa.struct([field("w", pa.int32()), field("h", pa.int32())]))]
    assert ("renamed", "box", "BOX") in changes(old, new)


def test_empty_and_unreadable(spark):
    s = spark.createDataFrame([("x", b"junk"), ("x", b"junk"), (None, None), ("y", pa.schema([field("a")]).serialize().to_pybytes())], "source_schema_id string, schema_ipc binary")
    uses = spark.createDataFrame([("x", 1), ("y", 2), (None, None)], "source_schema_id string, raw_row long")
    assert schemas.schema_changes(schemas.schema_versions(s, uses)).count() == 0
    none = spark.createDataFrame([], "endpoint string, adapter_version string, http_status int, source_error string, raw_format string, raw_zlib binary, raw_bytes long, raw_sha256 string")
    assert schemas.schema_changes(schemas.capture_versions(none)).count() == 0


def test_unified_keeps_every_record(spark, data):
    df = schemas.p3_exports(spark, data)
    raw = spark.read.parquet(f"{data}/raw_metadata.parquet").distinct()
    assert df.count() == raw.count()
    assert df.where("lineage IS NOT NULL AND f_id IS NOT NULL").count() > 0


def test_scores_decide_among_equal_evidence(monkeypatch):
    """Two fields share an id with the old one; what lies below them tells which it was."""
    old = [field("a", pa.struct([field("w", pa.int32()), field("h", pa.int32())]), field_id="1")]
    new = [field("x", pa.struct([field("q", pa.string())]), field_id="1"), field("y", pa.struct([field("w", pa.int32()), field("h", pa.int32())]), field_id="1")]
    assert ("renamed", "a", "y") in changes(old, new)
    monkeypatch.setattr(schemas, "SHARE", 0.0)
    assert ("renamed", "a", "x") in changes(old, new)


def test_unified_names_below_the_top_level(spark):
    import json

    struct = lambda *names: [{"name": "s", "id": None, "aliases": [], "type": "struct", "fields": [{"name": n, "id": str(k), "aliases": [], "type": "int64"} for k, n in enumerate(names)]}]
    listed = [{"name": "s", "id": None, "aliases": [], "type": "list", "element": struct("a", "b")[0]}, {"name": "l", "id": None, "aliases": [], "type": "list", "element": {"name": "", "id": None, "aliases": [], "type": "struct", "fields": struct("a", "b")}}]
    latest = [listed[0], {**listed[1], "element": {**listed[1]["element"], "fields": struct("a", "Bb")}}]
    v = spark.createDataFrame([("x", "1", 1, "name,id", json.dumps(struct("u", "w"))), ("x", "2", 2, "name,id", json.dumps(struct("u2", "w"))), ("x", "3", 3, "name,id", json.dumps(struct("z", "u3"))), ("y", "8", 1, "name,id", json.dumps(listed)), ("y", "9", 2, "name,id", json.dumps(latest))], "lineage string, version string, rank long, kinds string, tree string")
    df = spark.createDataFrame([("1", '{"s":{"u":1,"w":2}}'), ("2", '{"s":{"u2":1,"w":2,"u":5}}'), ("3", '{"s":{"z":1}}'), ("8", '{"l":[{"s":{"b":1}},{"b":2}],"l":[{"s":{"b":3}}]}'), ("9", '{"l":[]}')], "version string, text string")
    got = {r.version: json.loads(r.f_s or r.f_l) for r in schemas.unified(df, v, "version", "text", ["version"]).collect()}
    assert got == {"1": {"z": 1, "u3": 2}, "2": {"z": 1, "u3": 2, "u": 5}, "3": {"z": 1}, "8": [{"s": {"Bb": 3}}], "9": []}
