"""Specs, versions, scopes, paging, statistics, ranking, graphs, vectors, comparisons, rows, files, streams."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import runtime, stats, tags
from lakeloom.operators import graphs, preference as P, ranking as R, rows as ops, vectors as V
from lakeloom.plans import paging, scopes, versions
from lakeloom.plans.spec import Condition as C, QuerySpec, SpecError, compile_spec, derived_filter, lake_fields
from lakeloom.sources import files
from lakeloom.sources.lake import ASSET, OBJECT, OBSERVATION, Lake
from lakeloom.streaming import ingest

sha = "{:064x}".format


@pytest.fixture(scope="module")
def lake(spark):
    obs = [
        (101, 10, "g", 20, 100, "blue sky", False, 1), (102, 10, "e", 0, 2000, "red", True, 2), (201, 20, "g", 30, 3000, "blue", True, 1), (202, 20, "", None, 4000, "", False, 2),
        (301, 30, None, 10, 1500, None, None, 1), (401, None, "g", 50, 1600, "blue", False, 1), (501, 50, "g", 99, 9000, "blue", False, 1),
    ]
    objects = [(sha(n), n * 100, None if n == 6 else "webp") for n in (1, 2, 3, 4, 6)]
    assets = [(11, 101, 10, sha(1)), (12, 101, 10, sha(1)), (21, 201, 20, sha(2)), (31, 301, 30, sha(3)), (41, 401, None, sha(4)), (51, 501, 50, sha(5))]
    current = spark.createDataFrame([(10, 102, 11), (20, 202, 21), (30, 301, 31)], "post_id long, row_id long, asset_id long")
    return Lake(spark.createDataFrame(objects, OBJECT), spark.createDataFrame(assets, ASSET), spark.createDataFrame(obs, OBSERVATION), current)


@pytest.mark.parametrize(
    "rule, conditions, want",
    [
        ("any_observation", [C("post.score", "gte", ("10",)), C("image.width", "gte", ("1000",))], {2, 3, 4}),
        ("current_post", [C("post.score", "gte", ("10",)), C("image.width", "gte", ("1000",))], {3}),
        ("any_observation", [C("post.tags", "has_tag", ("blue",))], {1, 2, 4}),
        ("current_post", [C("post.rating", "in", ("g", "e"))], {1}),
        ("any_observation", [C("post.rating", "in", ("g", "e"))], {1, 2, 4}),
        ("any_observation", [C("post.tags", "has_all_tags", ("blue", "sky"))], {1}),
        ("any_observation", [C("post.tags", "has_any_tags", ("red", "sky"))], {1}),
        ("current_post", [C("post.tags", "has_no_tags", ("blue", "red"))], {2}),
        ("any_observation", [C("post.rating", "eq", ("e",)), C("post.tags", "has_all_tags", ("blue", "sky"))], set()),
        ("current_post", [C("post.rating", "eq", ("",))], {2}),
        ("current_post", [C("post.tags", "is_present")], {1, 2}),
        ("current_post", [C("post.tags", "is_missing")], {3}),
        ("current_post", [C("post.deleted", "eq", ("false",))], {2}),
        ("current_post", [C("post.rating", "ne", ("g",))], {1, 2}),
        ("current_post", [C("stored.extension", "is_missing")], {6}),
        ("any_observation", [C("post.tags", "has_tag", ("blue",)), C("post.tags", "has_no_tags", ("blue",))], set()),
        ("any_observation", [C("post.rating", "eq", ("x' OR 1=1 --",))], set()),
    ],
)
def test_specs(lake, rule, conditions, want):
    assert sorted(r[0] for r in compile_spec(QuerySpec(rule, tuple(conditions)), lake).collect()) == sorted(map(sha, want))


@pytest.mark.parametrize(
    "c", [C("nope", "eq", ("1",)), C("post.score", "eq", ("01",)), C("post.score", "has_tag", ("1",)), C("post.tags", "has_tag", ("a b",)), C("post.rating", "in", ()), C("post.rating", "eq", ("x" * 257,)), C("post.deleted", "eq", ("yes",)), C("post.score", "gte", (str(2**63),)), C("post.rating", "is_missing", ("x",))]
)
def test_specs_refused(c):
    with pytest.raises(SpecError):
        QuerySpec("current_post", (c,)).normalised(lake_fields())


def test_fingerprint_ignores_order():
    a, b = C("post.rating", "in", ("e", "g")), C("post.score", "gte", ("1",))
    n = lambda *c: QuerySpec("current_post", c).normalised(lake_fields()).fingerprint()
    assert n(a, b) == n(b, a, a) == n(b, C("post.rating", "in", ("g", "e", "g"))) != n(a)


def test_delta_is_rebuild(spark):
    rng = random.Random(1)
    obs = [(i, rng.choice([None, *range(12)]), rng.choice(["g", "s", None]), rng.randrange(60), 1, "t", False, rng.randrange(1, 9)) for i in range(120)]
    assets = [(i, o[0], o[1], sha(rng.randrange(25))) for i, o in enumerate(obs)]
    o, a = spark.createDataFrame(obs, OBSERVATION), spark.createDataFrame(assets, ASSET)
    whole = Lake(spark.createDataFrame([(sha(n), n, "x") for n in range(25)], OBJECT), a, o, None)
    for rule in ("current_post", "any_observation"):
        spec = QuerySpec(rule, (C("post.rating", "eq", ("g",)), C("post.score", "gte", ("20",))))
        for after, until in ((2, 3), (3, 6), (1, 8)):
            before = compile_spec(spec, versions.as_of(whole, after))
            assert {r[0] for r in versions.delta(spec, whole, before, after, until).collect()} == {r[0] for r in compile_spec(spec, versions.as_of(whole, until)).collect()}
    w = versions.post_intervals(o, ["rating"])
    for s in (1, 4, 8):
        assert sorted((r.post_id, r.row_id) for r in versions.at(w, s).collect()) == sorted((r.post_id, r.row_id) for r in versions.as_of(whole, s).current_posts.collect())


def test_versions_small(spark):
    i = spark.createDataFrame([(1, 1, 5), (1, 5, None), (2, 90, 95), (2, 95, None)], "post_id long, valid_from long, valid_until long")
    assert versions.vacuum(i, 100, []).count() == 3 and versions.vacuum(i, 100, [3]).count() == 4
    b = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("a", "3")], "k string, f string")
    assert sorted(map(tuple, versions.accept(b.limit(1), b, "k", "f").collect())) == [("a", "3"), ("b", "2")]
    known = {"generation": 1, "seq": 2, "batch": "x"}
    assert versions.continuous(known, {"generation": 1, "batches": {2: "x"}, "seqs": [2, 3]}) and not versions.continuous(known, {"generation": 1, "batches": {2: "x"}, "seqs": [2, 4]})


def test_scopes(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "key long")
    keys = lambda df: sorted(r[0] for r in df.select("key").collect())
    assert keys(scopes.resolve(k(1, 2, 2, 3), k(4, 2), k(2, 3), ["key"])) == [1, 2, 4]
    edits = spark.createDataFrame([], "key long, since int, until int, present boolean")
    one = scopes.edit(edits, spark.createDataFrame([(1, False), (9, True)], "key long, present boolean"), ["key"], 1, 0, 0)
    two = scopes.edit(one, spark.createDataFrame([(1, True)], "key long, present boolean"), ["key"], 2, 1, 1)
    assert [keys(scopes.at_revision(k(1, 2), two, ["key"], r)) for r in (0, 1, 2)] == [[1, 2], [2, 9], [1, 2, 9]]
    with pytest.raises(ValueError):
        scopes.edit(edits, edits.select("key", "present"), ["key"], 2, 0, 1)
    assert scopes.multiset_difference(k(1, 1, 2), k(1, 2, 3)).count() == 2


def test_pages_follow_each_other(spark):
    rows = [(random.Random(i).choice([None, 1, 2, 3]), s, i) for i in range(40) for s in "ab"]
    df = spark.createDataFrame(rows, "post_id long, source_id string, asset_id long")
    for down in (False, True):
        keys, cursor, seen = [("post_id", down), ("source_id", False), ("asset_id", down)], None, []
        while True:
            got = paging.page(df, keys, 7, cursor).collect()
            seen += [tuple(r) for r in got[:7]]
            if len(got) < 8:
                break
            cursor = got[6].asDict()
        want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or 0) * (-1 if down else 1), r[1], r[2] * (-1 if down else 1)))
        assert seen == want
    assert paging.evenly_spaced(10, 4) == [0, 3, 6, 9] and paging.evenly_spaced(3, 5) == [0, 1, 2] and paging.evenly_spaced(9, 1) == [0]


def test_positions_and_totals(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"))
    got = {r.id: r.position for r in paging.positions(df.repartition(7), [F.col("v"), F.col("id")], ["g"]).collect()}
    for g in range(3):
        order = sorted((i for i in range(1000) if i % 3 == g), key=lambda i: (i * 7919 % 101, i))
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    assert [r.pos for r in runtime.global_positions(df.limit(0), [F.col("id")]).collect()] == []
    t = stats.running_totals(df, ["g"], [F.col("id")], "v", "bigint").orderBy("id").collect()
    sums = {0: 0, 1: 0, 2: 0}
    for r in t:
        assert r.before == sums[r.g]
        sums[r.g] += r.v
    assert all(r.total == sums[r.g] for r in t)


def test_midranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("a", None), ("b", None), (None, 3)], "g string, v long")
    got = sorted((str(r.g), str(r.v), r.percentile) for r in stats.midranks(df, ["g"], "v").collect())
    assert got == [("None", "3", 0.5), ("a", "1", 1 / 3), ("a", "1", 1 / 3), ("a", "5", 2.5 / 3), ("a", "None", None), ("b", "None", None)]


def test_window_ranks_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(-20, 50)]), rng.choice([None, *range(8)])) for i in range(300)]
    rows = [(i, g, t, None if t is None else t - rng.randrange(12), None if t is None else t + rng.randrange(12), v) for i, g, t, v in rows]
    df = spark.createDataFrame(rows, "id long, g string, t long, lo long, hi long, v long")
    for r in R.window_ranks(df, ["g"], "t", "lo", "hi", "v").collect():
        if r.v is None or r.t is None:
            assert r.n is None
            continue
        near = [x[5] for x in rows if x[1] == r.g and x[5] is not None and x[2] is not None and r.lo <= x[2] <= r.hi]
        assert (r.n, r.less, r.equal) == (len(near), sum(v < r.v for v in near), sum(v == r.v for v in near))
    assert R.window_ranks(df.limit(0), ["g"], "t", "lo", "hi", "v").count() == 0


def test_quotas_and_ties(spark):
    for n in range(3000):
        q = R.quotas(n, [280, 43, 10])
        assert sum(q) == n * 333 // 1000 and all(abs(x - n * p / 1000) < 1 for x, p in zip(q, [280, 43, 10]))
    share, free = R.capacities({2000: 3, 2001: 100, 2002: 1}, 50)
    assert sum(share.values()) + free == 50 and all(share[y] <= c for y, c in {2000: 3, 2001: 100, 2002: 1}.items())
    row = spark.range(1).select(R.tie_key("d", "seed", F.lit("k")).alias("h"), R.heat(F.lit(2**62), F.lit(2**62)).cast("string").alias("big"), R.heat(F.lit(None).cast("long"), F.lit(-1)).alias("none"), R.heat(F.lit(4), F.lit(None).cast("long")).alias("one")).first()
    assert row.h == hashlib.sha256(b"d\0" + (4).to_bytes(8, "big") + b"seedk").hexdigest()
    assert int(row.big) == (2**62 + 1) ** 2 and row.none is None and row.one == 25


def test_routes_keep_every_row(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 17).cast("double").alias("m"), (F.col("id") % 5).cast("double").alias("r"))
    out = R.routes(df, "g", "m", "r", F.col("id"), "id", [280, 43, 10])
    assert out.count() == 500 and {(r.g, r.route): r["count"] for r in out.groupBy("g", "route").count().collect()}[("0", "main")] == R.quotas(250, [280, 43, 10])[0]


def test_components_and_depths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(50)] + [(5000, 5000), (None, 3)] + [(7000, 7001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in graphs.components(df).collect()} == {x: root(x) for x in parent}
    assert graphs.components(df.limit(0)).count() == 0
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 5), (3, 4, 2), (3, 1, 0)], "src long, dst long, step int")
    roots = spark.createDataFrame([(1, 0)], "node long, depth int")
    assert {r.node: r.depth for r in graphs.least_depths(roots, e, 4).collect()} == {1: 0, 2: 1, 3: 2, 4: 4}
    asks = spark.createDataFrame([(1, "s", 5), (2, "s", 10)], "ask_id int, scope string, x int")
    pages = spark.createDataFrame([(1, "s", 0, 10, 7), (2, "s", 4, 6, 9), (3, "s", 9, 20, 1)], "page_id int, scope string, lower int, through int, fetched int")
    assert [tuple(r) for r in graphs.covering_page(asks, pages, 10, 5).collect()] == [(1, 2)]


def test_hamming_is_complete(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = base + [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 10))) for h in base for _ in range(4)]
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)) + [(999, None)], "id long, h long")
    classes, members = V.hamming_classes(df, "id", "h")
    rep = {}
    for i, h in enumerate(hashes):
        rep.setdefault(h, i)
    want = {(rep[a], rep[b], (a ^ b).bit_count()) for a, b in itertools.combinations(rep, 2) if (a ^ b).bit_count() <= 7}
    want = {(min(a, b), max(a, b), d) for a, b, d in want}
    assert sorted(tuple(r) for r in V.hamming_pairs(classes, 7).collect()) == sorted(want) and want
    assert {r.id: r.rep for r in members.collect()} == {i: rep[h] for i, h in enumerate(hashes)}


def test_index_recall(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(640, 24)) + np.repeat(rng.normal(size=(16, 24)) * 2, 40, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 24), (9001, None), (9002, [])], "id long, v array<double>")
    c = V.fit_centroids(df, "v", 16)
    index = V.indexed(df, "id", "v", c)
    assert index.count() == 640
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = df.where("id % 20 = 0 AND id < 640").select(F.col("id").alias("query"), V.normalised("v").alias("u"))
    got = {}
    for r in V.batch_nearest(asked, index, "id", c, 10, 8).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    hit = [len(got[q] & set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist())) / 10 for q in got]
    assert len(got) == 32 and np.mean(hit) >= 0.9
    exact = [r.id for r in V.nearest(df, "id", "v", x[3].tolist(), 5).collect()]
    assert exact == np.argsort(-(u @ u[3]), kind="stable")[:5].tolist() and [r.id for r in V.probe(index, "id", c, x[3].tolist(), 5, len(c)).collect()] == exact


def test_preference_fit(spark):
    rng = random.Random(6)
    batches = [(b, [[x] for x in sorted(rng.sample(range(12), 4), key=lambda i: i + rng.gauss(0, 2))]) for b in range(60)] + [(100, [[50, 51]]), (101, [[9]]), (102, [])]
    df = spark.createDataFrame(batches, "batch long, tiers array<array<long>>")
    p = P.pairs(df)
    fit = {r["item"]: r for r in P.davidson(p).collect()}
    assert fit[0].score > fit[6].score > fit[11].score and {fit[i].component for i in range(12)} == {0} and fit[50].component == fit[51].component == 50
    grad = dict.fromkeys(fit, 0.0)
    for r in p.collect():
        d = (fit[r.i].score - fit[r.j].score) / 2
        mean = (math.exp(d) + 0.5) / (math.exp(d) + math.exp(-d) + 1)
        grad[r.i] += r.w * (r.y - mean)
        grad[r.j] -= r.w * (r.y - mean)
    assert max(abs(g - P.REGULAR * fit[i].score) for i, g in grad.items()) < 1e-3
    P.LOCAL_PAIRS, held = 0, P.LOCAL_PAIRS
    try:  # two distributed rounds move as two local ones
        far = {r["item"]: r.score for r in P.davidson(p, rounds=2, strict=False).collect()}
    finally:
        P.LOCAL_PAIRS = held
    near = {r["item"]: r.score for r in P.davidson(p, rounds=2, strict=False).collect()}
    assert far.keys() == near.keys() and all(abs(far[i] - near[i]) < 1e-9 for i in far)
    b = {r["item"]: r.score for r in P.borda(p).collect()}
    assert b[0] > b[11] and b[50] == 0.5
    halves = P.split_half(df)
    assert halves[0].count() + halves[1].count() == df.count()
    assert all(0 < r.opponents < 64 for r in P.diversity(p).collect())
    nxt = P.next_batches(spark.createDataFrame([(i, f["score"]) for i, f in fit.items()], "item long, s double"), "s", "item", "x")
    assert nxt.count() == len(fit) == nxt.select("item").distinct().count()
    reviews = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 9, "c"), (2, 3, "d")], "ordinal long, seq long, decision string")
    assert sorted(map(tuple, P.latest_review(reviews, 6).collect())) == [(1, "b"), (2, "d")]


def test_rows(spark):
    df = spark.createDataFrame([(1, 2**62), (2, None), (3, 5)], "ordinal long, value long")
    r = ops.default_registry()
    assert [tuple(x) for x in r.apply(df, "scalar", 1, {"multiply": 4, "add": 1}).orderBy("ordinal").collect()] == [(1, "failed", None, "INTEGER_OVERFLOW"), (2, "missing", None, None), (3, "available", 21, None)]
    with pytest.raises(ValueError):
        r.apply(df, "manifest", 1, {"fields": ["value"]})
    with pytest.raises(KeyError):
        r.apply(df, "scalar", 2, {})
    with pytest.raises(ValueError):
        r.add(ops.Operator("scalar", 1, (), dict, lambda a, b: a))
    n = spark.createDataFrame([(7, 'a/b:c?  .', "png"), (8, "", None)], "ordinal long, stem string, extension string")
    assert sorted(x.file_name for x in r.apply(n, "export_names", 1, {}).collect()) == ["000007_a_b_c_.png", "000008_item.bin"]
    assert spark.range(1).select(ops.sidecar(F.lit("a_b  c"), "spaces").alias("s")).first().s == "a b, c"
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    col = spark.createDataFrame([(1, "available", 9), (2, "missing", None)], "k long, status string, value long")
    assert [[x.k for x in derived_filter(keys, col, "k", *a).collect()] for a in (("gte", 5), ("is_missing",), ("is_present",), ("ne", 9))] == [[1], [2], [1], []]


def test_files(spark, tmp_path):
    data = [b"alpha", b"beta!", b""]
    (tmp_path / "p.tar").write_bytes(b"".join(data))
    rows, at = [], 0
    for i, b in enumerate(data):
        rows.append((i, "p.tar", at, len(b), hashlib.sha256(b).hexdigest()))
        at += len(b)
    rows += [(7, "p.tar", 0, 5, "0" * 64), (8, "gone.tar", 0, 5, "0" * 64), (9, "p.tar", 8, 50, "0" * 64), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, pack_path string, offset long, length long, sha256 string")
    got = {r.id: (r.ok, r.data) for r in files.packed_ranges(df, str(tmp_path), "id").collect()}
    assert {i for i, x in got.items() if x[0]} == {0, 1, 2} and bytes(got[1][1]) == b"beta!"
    m = spark.createDataFrame([("in.bin", "p.tar", 5)], "path string, container string, start long")
    inner = spark.createDataFrame([(1, "in.bin", 0, 5, hashlib.sha256(b"beta!").hexdigest())], df.schema)
    assert files.packed_ranges(files.container_members(inner, m), str(tmp_path), "id").first().ok
    pages = spark.createDataFrame([("x", '{"posts":[{"a": 1},{"b":"é"}]}'), ("y", None), ("z", "{}")], "k string, t string")
    assert [r.record for r in files.json_page(pages, "k", "t", "$.posts").orderBy("position").collect()] == ['{"a":1}', '{"b":"é"}']
    html = spark.createDataFrame([(1, '<script type="application/json">{"a":1}</script><script>x</script><script type="application/json">{bad</script>'), (2, None)], "k long, h string")
    assert [r.resource for r in files.embedded_resources(html, "k", "h").collect()] == ['{"a":1}']
    n = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    folder = f"{tmp_path}/sealed"
    first = files.seal(n, folder, ["id", "g"], "g")
    assert files.seal(n.repartition(3), folder, ["id", "g"], "g") == first and files.open_sealed(spark, folder).count() == 100
    with pytest.raises(ValueError):
        files.seal(n.limit(5), folder, ["id", "g"])
    files.write_json_lines(n.limit(2), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 2
    n.repartition(9).write.parquet(f"{tmp_path}/many")
    assert files.compact(spark, f"{tmp_path}/many", f"{tmp_path}/few") == 1 and spark.read.parquet(f"{tmp_path}/few").count() == 100
    out = spark.createDataFrame([("a.png", b"123", "x, y"), ("b.bin", b"", None)], "file_name string, data binary, sidecar string")
    assert sorted(map(tuple, files.write_exports(out, f"{tmp_path}/out").collect())) == [("a.png", 3), ("b.bin", 0)]
    assert (tmp_path / "out/a.png.txt").read_text() == "x, y" and not (tmp_path / "out/b.bin.txt").exists()
    with pytest.raises(Exception, match="file name"):
        files.write_exports(spark.createDataFrame([("../x", b"", None)], out.schema), f"{tmp_path}/out").collect()
    assert files.generated(spark).count() == 32


def test_stream_is_batch(spark, tmp_path):
    schema = "id long, v long, at timestamp"
    rows = spark.sql("SELECT id, id % 7 AS v, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id % 50) AS at FROM range(60)").withColumn("id", F.col("id") % 20)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b")
    import pyspark.sql.types as T

    stream = ingest.read_batches(spark, f"{tmp_path}/in/*", T._parse_datatype_string(schema), 1)
    q = ingest.ingest(stream, f"{tmp_path}/lake", f"{tmp_path}/cp", ["id", "v", "at"])
    q.awaitTermination(60)
    got = {r.id: r["at"] for r in ingest.current(spark, f"{tmp_path}/lake", ["id"], ["at", "v"], ["v", "at"]).collect()}
    want = {r.id: r["at"] for r in rows.groupBy("id").agg(F.max("at").alias("at")).collect()}
    assert got == want
    counts = ingest.windowed_counts(ingest.read_batches(spark, f"{tmp_path}/in/*", T._parse_datatype_string(schema), 1), "at", "v")
    w = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 120


def test_tags(spark):
    df = spark.createDataFrame([(1, "b a  b"), (2, "a b"), (3, ""), (4, None)], "id long, t string")
    assert {r.tag: r.n for r in tags.dictionary(df, "t").collect()} == {"a": 2, "b": 2}
    f = {r.id: r.f for r in df.select("id", tags.fingerprint("t").alias("f")).collect()}
    assert f[1] == f[2] != f[3] and f[4] is None
    assert tags.postings(df, "id", "t").count() == 4
