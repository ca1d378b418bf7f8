import hashlib
import json
import zlib

import pytest

from lakeloom.functions import skeletons
from lakeloom.operators import nested


def walk(x, path, scope, child, out):
    """Plain recursion over the rules."""
    if isinstance(x, dict):
        if child:
            out.append((path, scope))
            scope = path
        digits = all(k.isascii() and k.isdigit() for k in x)
        for k, y in x.items():
            if k.endswith("_json") and isinstance(y, str):
                try:
                    z = json.loads(y)
                    y = z if isinstance(z, (dict, list)) else y
                except ValueError:
                    pass
            p = f"{path}.{k}"
            if isinstance(y, dict):
                single = not digits and k in nested.COLLECTION_FIELDS
                walk(y, p + "[0]" * single, scope, digits or single, out)
            elif isinstance(y, list):
                walk(y, p, scope, False, out)
    elif isinstance(x, list):
        for i, y in enumerate(x):
            walk(y, f"{path}[{i}]", scope, isinstance(y, dict), out)


def brute(text):
    out = []
    try:
        walk(json.loads(text.removeprefix("﻿")), "$", "$", False, out)
    except ValueError:
        pass
    return out


TEXTS = [
    '{"a":[{"b":1},2,null,[{"c":[[],[{"d":{}}]]}]]}', '{"tags":{"x":1,"notes":{"y":[{}]}},"other":{"z":{}}}', '{"works":{"12":{"pages":[{}]},"7":null,"8":[{}]},"mixed":{"1":{},"a":{}}}',
    '{"cursor_json":"{\\"terms\\":{\\"tag\\":1},\\"in_json\\":\\"[{}]\\"}","bad_json":"nope","n_json":"7","tags_json":"[[{}]]"}', '﻿[{"k.v":[{}]},{}]', '[]', '{}', '""', "7", "null", "", " ", "[1,2", '{"a":[{}]} x', '{"a":[{}]}{"b":[{}]}', '{"a":[{}]},{"b":[{}]}', '[{}],[{}]', '{"a":NaN}', '{"a":[{"b":1,"b":[{}]}]}',
    json.dumps({"children": [{"children": {"children": [{}] * 3}}] * 200}), '{"\\u0061":[{"\\u007bb":[{}]}]}', "[" * 60 + '{"x":{}}' + "]" * 60,
]


@pytest.mark.parametrize("values", [False, True])
def test_children_of_texts(spark, values):
    rows = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(TEXTS)] + [("null", None, "x"), (None, '[{"a":1}]', "x")], "id string, body string, node_path string")
    got = sorted((r.id or "", r.node_path, r.parent_path) for r in nested.flatten_records(rows.select("id", "body"), ["id"], "body", values=values).collect())
    want = sorted([(str(i), *n) for i, t in enumerate(TEXTS) if "NaN" not in t for n in brute(t)] + [("", "$[0]", "$")])
    assert got == want


def test_deep_texts_by_the_same_rules(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, body string")
    monkeypatch.setattr(skeletons, "DEEP", 1)
    for values in (False, True):
        out = skeletons._Columns(values, nested.COLLECTION_FIELDS)
        for t in TEXTS:
            out.add(skeletons.parse(t))
        assert len(out.deep) > 100
        walked = sorted((str(i), *out.deep[k][:3:2]) for i, (a, b) in enumerate(zip(out.deep_rows, out.deep_rows[1:])) for k in range(a, b))
        want = sorted((str(i), *n) for i, t in enumerate(TEXTS) if "NaN" not in t for n in brute(t))
        assert walked == [w for w in want if w[0] in {x[0] for x in walked}]
    assert nested.flatten_records(rows, ["id"], "body").count() == sum(len(brute(t)) for t in TEXTS if "NaN" not in t)


def test_values_and_one_collection(spark):
    rows = spark.createDataFrame([("r", '{"pages":[{"w":1,"t":"x","u":null,"crops":[{"b":true}]}],"notes":{"n":1.5}}')], "id string, body string")
    got = {(r.node_path, r.field): r["values"] for r in nested.flatten_records(rows, ["id"], "body").collect()}
    assert got == {("$.pages[0]", "pages"): {"w": "1", "t": "x", "u": None}, ("$.pages[0].crops[0]", "crops"): {"b": "true"}, ("$.notes[0]", "notes"): {"n": "1.5"}}
    assert [r.node_path for r in nested.flatten_records(rows, ["id"], "body", only="crops").collect()] == ["$.pages[0].crops[0]"]


def capture(i, body, request, damage=0):
    z, h = zlib.compress(body), hashlib.sha256(body).hexdigest()
    z = z[:-4] if damage == 1 else z
    return (i, request, z, len(body) + (damage == 2), "0" * 64 if damage == 3 else h, "extra")


def test_captures_and_items(spark, tmp_path):
    good = b'{"pages":[{}]}'
    captures = [capture("a", good, "[{}]"), capture("a", good, "[{}]"), capture("b", good, "[{}]", 1), capture("b", good, "[{}]"), *[capture(f"d{k}", good, "[{},{}]", k) for k in (1, 2, 3)], capture("u", b"\xff", None), ("n", None, None, None, None, None), (None, "[{}]", None, None, None, None)]
    items = [("j", 1, '{"tags":{}}', 0), ("j", 1, '{"notes":{}}', 2), ("j", 1, '{"notes":{}}', 2), ("j", 2, None, 1), (None, None, "[{}]", None), ("", 3, "", 1)]
    spark.createDataFrame(captures, "capture_id string, request_json string, raw_zlib binary, raw_bytes long, raw_sha256 string, text string").write.parquet(f"{tmp_path}/captures.parquet")
    spark.createDataFrame(items, "job_id string, post_id long, record_json string, attempts int").write.parquet(f"{tmp_path}/items.parquet")
    got = sorted((r.source_field, r.record_id or "", r.node_path) for r in nested.p1_found(spark, str(tmp_path)).collect())
    raw, req, item = "captures.raw_zlib", "captures.request_json", "items.record_json"
    want = [(raw, "a", "$.pages[0]"), (raw, "b", "$.pages[0]"), (req, "", "$[0]"), (req, "a", "$[0]"), (req, "b", "$[0]"), *[(req, f"d{k}", f"$[{i}]") for k in (1, 2, 3) for i in (0, 1)], (item, "/", "$[0]"), (item, "j/1", "$.notes[0]")]
    assert got == sorted(want)


def test_empty_tables(spark):
    assert nested.flatten_records(spark.createDataFrame([], "id string, body string"), ["id"], "body").count() == 0


def test_given_data(spark, data):
    rows = spark.read.parquet(f"{data}/items.parquet")
    best = nested.best_items(rows).collect()
    got = sorted((r.record_id, r.node_path, r.parent_path) for r in nested.flatten_records(nested.best_items(rows), ["record_id"], "record_json").collect())
    assert got == sorted((r.record_id, *n) for r in best if r.record_json for n in brute(r.record_json))


def test_depth_has_no_limit(spark):
    deep = '{"children":[' * 3000 + "{}" + "]}" * 3000
    lists = "[" * 4000 + '{"x":{}}' + "]" * 4000
    rows = spark.createDataFrame([("d", deep), ("l", lists), ("bad", "[" * 20_000), ("more", "[" * 20_000 + "]" * 20_001)], "id string, body string")
    got = nested.flatten_records(rows, ["id"], "body", values=False).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"d": 3000, "l": 1}


def test_parser_with_its_own_stack():
    for t in [*TEXTS, '{"a":1,}', "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", '{"a":"\\u00e9\\ud83d\\ude00","a":-1.5e3}', '["a\nb"]', "01", "-", " [true , false,null ] ", '"x"', "[]]", "{}{}"]:
        if "NaN" in t or t.startswith("﻿"):
            continue
        try:
            want = json.loads(t)
        except ValueError:
            with pytest.raises(ValueError):
                skeletons.parse_deep(t)
            continue
        assert skeletons.parse_deep(t) == want


def test_flat_tables_of_one_walk(spark):
    rows = spark.createDataFrame([("r", '{"pages":[{"id":1,"width":5,"comments":{"id":"c","text":"x","terms":[{"id":7},{"id":8}]}}],"terms":[{"name":"n"}]}'), (None, "[{}]"), ("n", None)], "id string, body string")
    coded = rows.select("id", skeletons.skeletons_of_texts(True)("body").alias("skeleton"))
    t = nested.flat_tables(coded, ["id"], "skeleton", {k: nested.TABLES[k] for k in ("pages", "comments", "terms")})
    assert [tuple(r) for r in t["pages"].collect()] == [("r", "$.pages[0]", "$", "1", "5", None, None)]
    assert [tuple(r) for r in t["comments"].collect()] == [("r", "$.pages[0].comments[0]", "$.pages[0]", "c", "x")]
    assert sorted(r.parent_path for r in t["terms"].collect()) == ["$", "$.pages[0].comments[0]", "$.pages[0].comments[0]"]
