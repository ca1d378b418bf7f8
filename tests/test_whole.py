"""Queries that do the whole job, against plain recomputation."""

import datetime
import hashlib
import itertools
import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from lakeloom.functions import runtime
from lakeloom.operators import graphs, population, preference as P, ranking as R, schemas, vectors as V
from lakeloom.plans import analyses, details, rankings
from lakeloom.sources.lake import from_members


def test_batches_of_any_size_give_all_pairs(spark):
    df = spark.createDataFrame([(1, [list(range(5)), list(range(5, 40))]), (2, [[90]])], "batch long, tiers array<array<long>>")
    got = {(r.i, r.j): (r.y, r.w) for r in P.pairs(df).collect()}
    assert got.keys() == set(itertools.combinations(range(40), 2)) and {w for _, w in got.values()} == {2 / (40 * 39)}
    assert got[0, 1][0] == got[6, 7][0] == 0.5 and got[4, 5][0] == 1.0


def test_all_parts_are_compared(spark, tmp_path):
    sizes = {k: k * 7 % 50 + 1 for k in range(1, 3 * 211 * 17, 3)}  # 17 a batch by the rest of the key
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    d, keys, met = str(tmp_path), sorted(sizes), defaultdict(set)
    members = [keys[k : k + 16] for k in range(0, len(keys), 16)]
    if len(members[-1]) < 16:
        members[-2:] = [members[-2] + members[-1]]
    want = {(b, *sorted(x, key=lambda k: (sizes[k] // 10, k))) for b, m in enumerate(members) for x in itertools.combinations(m, 2)}
    rows = analyses.pair_expand(spark, d).collect()
    assert {(r.batch, r.i, r.j) for r in rows} == want and len(rows) == len(want)
    assert all(r.y == (1.0 if sizes[r.i] // 10 < sizes[r.j] // 10 else 0.5) for r in rows)
    for r in rows:
        met[r.i].add(r.y)
        met[r.j].add(1 - r.y)
    assert {r["item"] for r in analyses.borda(spark, d).collect()} == {r["item"] for r in analyses.davidson(spark, d).collect()} == set(keys) == met.keys()


def versions(spark, rows):
    """Rows of (lineage, version, rank, {field: type})."""
    tree = lambda fields: json.dumps([{"name": n, "id": None, "aliases": [], "type": t} for n, t in fields.items()])
    return spark.createDataFrame([(x, v, r, "name,normal", tree(f)) for x, v, r, f in rows], "lineage string, version string, rank long, kinds string, tree string")


def test_unified_loses_no_value(spark):
    v = versions(spark, [("x", "1", 1, {"talk": "string", "n": "int64", "d": "double"}), ("x", "2", 2, {"talk": "int64", "n": "int64", "d": "double"})])
    texts = [("1", '{"talk": "apron", "n": "many", "d": 1}'), ("2", '{"talk": 5, "n": "7", "d": 1.5}'), ("2", '{"n": 7.5, "d": {"a": 1}, "new": [1]}'), ("?", '{"a": 1, "b": null}'), ("2", "[3]"), ("2", None)]
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, version string, text string")
    rows = sorted(schemas.unified(df, v, "version", "text", ["k"]).collect())
    got = [(r.f_talk, r.f_n, r.f_d, r.rest and json.loads(r.rest)) for r in rows]
    assert got == [
        ("apron", None, 1.0, {"n": "many"}), ("5", 7, 1.5, None), (None, None, None, {"n": 7.5, "d": {"a": 1}, "new": [1]}),
        (None, None, None, {"a": 1}), (None, None, None, {"$": "[3]"}), (None, None, None, None),
    ]


def test_unified_holds_exports_and_captures(spark, data, duck):
    want = set()
    for cid, endpoint, version, body, size, digest in duck.sql(f"select capture_id, endpoint, adapter_version, raw_zlib, raw_bytes, raw_sha256 from captures where {schemas.GOOD}").fetchall():
        try:
            raw = zlib.decompress(body)
            v = json.loads(raw.decode().removeprefix("﻿"))
        except (zlib.error, ValueError, TypeError):
            continue
        if len(raw) == size and hashlib.sha256(raw).hexdigest() == digest and isinstance(v, dict):
            p = v["body"] if v.get("body") is not None else (v.get("resource_response") or {}).get("data")
            want |= {(cid, k, f"captures:{endpoint}", version, len([y for y in x.values() if y is not None])) for k, x in enumerate(p if isinstance(p, list) else [p]) if isinstance(x, dict)}
    df = schemas.p3_unified(spark, data).cache()
    fields = [c for c in df.columns if c.startswith("f_")]
    got = [(r.record_id, r.element, r.lineage, r.version, sum(r[c] is not None for c in fields) + len(json.loads(r.rest or "{}"))) for r in df.where("lineage LIKE 'captures:%'").collect()]
    assert set(got) == want and len(got) == len(want) > 0
    assert df.where("element IS NULL").count() == schemas.p3_exports(spark, data).count()


def test_history_of_every_asset(spark, data):
    lake = from_members(spark, data)
    observed = [(r.row_id, r.post_id, r.commit_seq) for r in lake.observations.collect()]
    assets = lake.assets.collect()
    want = sorted((a.asset_id, r, c, "origin" if r == a.row_id else "same_post") for a in assets for r, p, c in observed if r == a.row_id or (p is not None and p == a.post_id))
    assert sorted(map(tuple, details.history(spark, data).collect())) == want
    assert {x[0] for x in want} == {a.asset_id for a in assets}


def test_graph_of_all_lines(spark, tmp_path):
    links = [(p, s, q, 0.01 * q) for p, s, q in [(1, 1, 3), (2, 1, 50), (2, 2, 4), (3, 3, 5), (30, 3, 6), (30, 4, 1), (31, 4, 2), (31, 5, 3), (40, 9, 7), (40, 9, 7)]]
    spark.createDataFrame(links, "l_partkey long, l_suppkey long, l_quantity int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, 1 if p in (1, 3, 99) else 5) for p in (1, 2, 3, 30, 31, 40, 99)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    far, parent, near = 10_000_000, {}, defaultdict(set)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, s, *_ in links:
        x, y = root(p), root(s + far)
        parent[max(x, y)] = min(x, y)
        near[p].add(s + far)
        near[s + far].add(p)
    assert {r.node: r.component for r in analyses.components(spark, str(tmp_path)).collect()} == {x: root(x) for x in parent}
    depth = dict.fromkeys((1, 3), 0)
    for step in range(1, 5):
        for x in [x for x, k in depth.items() if k == step - 1]:
            for y in near[x]:
                depth.setdefault(y, step)
    assert {r.node: r.depth for r in analyses.depths(spark, str(tmp_path)).collect()} == depth and max(depth.values()) == 4


def test_all_rungs_of_the_cohort_ladder(spark, data, duck):
    rungs = " UNION ALL ".join(f"SELECT {k} AS level, {m} AS m, id, rating, created, heat, age, CASE WHEN age >= 0 THEN len([e FOR e IN {edges} IF e::HUGEINT * 86400000000 <= age]) END AS b FROM h" for k, (m, edges) in enumerate(R.LADDER))
    sql = f"""{rankings._POP}, a AS ({rungs}),
    w AS (SELECT x.id, x.level, count(*) AS n, sum(CASE WHEN y.heat < x.heat THEN 1.0 WHEN y.heat = x.heat THEN 0.5 ELSE 0 END) / count(*) AS p FROM a x JOIN a y ON x.level = y.level AND x.rating = y.rating AND x.b = y.b
      AND y.created BETWEEN x.created - to_months(x.m) AND x.created + to_months(x.m) WHERE x.heat IS NOT NULL AND y.heat IS NOT NULL GROUP BY ALL HAVING count(*) >= 200)
    SELECT h.id, level, n, round(p, 9) FROM h LEFT JOIN (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY level) = 1) USING (id)"""
    want = {r[0]: (r[1], r[2], r[3] and round(r[3], 6)) for r in duck.sql(sql).fetchall()}
    got = {r.id: (r.level, r.cohort_n, r.local and round(r.local, 6)) for r in rankings.cohort(spark, data).collect()}
    assert got == want and any((x[0] or 0) > 1 for x in got.values())


def test_all_components_and_all_asked_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(130, 64))
    x[65:] = x[:65]
    for i in range(65, 130):  # from none to eight signs are turned, in any of the components
        x[i, rng.choice(64, i % 9, replace=False)] *= -1
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)] + [(140, [0.0] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, bits = str(tmp_path), {i: tuple(y > 0 for y in v) for i, v, _ in rows}
    rep = {i: min(j for j in bits if bits[j] == b) for i, b in bits.items()}
    apart = {(a, b): sum(p != q for p, q in zip(bits[a], bits[b])) for a, b in itertools.combinations(sorted(set(rep.values())), 2)}
    classes, members = V.hamming_classes(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", V.sign_hash("embedding").alias("hash")), "vec_id", "hash")
    got = {(r.a, r.b): r.distance for r in V.hamming_pairs(classes, 7).collect()}
    assert got == {k: n for k, n in apart.items() if n <= 7} and set(got.values()) == set(range(1, 8))
    assert {r.vec_id: r.rep for r in members.collect()} == rep
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for query, k, among in ((analyses.knn, 20, range(130)), (analyses.knn_filtered, 10, [i for i in range(130) if i % 4 in (1, 3)])):
        found = defaultdict(list)
        for r in sorted(query(spark, d).collect(), key=lambda r: r["rank"]):
            found[r["query"]].append(round(r.distance, 5))
        assert set(found) == set(range(0, 130, 20))
        for q, ds in found.items():
            assert np.allclose(ds, sorted(1 - u[i] @ u[q] for i in among)[:k], atol=2e-5)


def test_pages_over_one_place_stay_apart_from_asks(spark):
    """Many pages over the same places, and many asks there: no join may list their pairs."""
    rng = random.Random(8)
    pages = [(k, rng.choice(["a", "b", None]), (low := rng.randrange(-30, 60)), low + rng.randrange(-1, 40), rng.randrange(20)) for k in range(3000)]
    asks = [(k % 900, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-40, 110)])) for k in range(1000)]
    a, p = spark.createDataFrame(asks, "ask_id int, scope string, x int"), spark.createDataFrame(pages, "page_id int, scope string, lower int, through int, fetched int")
    got = graphs.covering_page(a, p, 20, 12)
    rows, want = {r.ask_id: r.page_id for r in got.collect()}, {}
    for k, scope, x in asks:
        for page, s, low, through, fetched in pages:
            if s == scope is not None and x is not None and low <= x < through and fetched >= 8:
                want[k] = max(want.get(k, (0, 0)), (fetched, page))
    assert rows == {k: page for k, (_, page) in want.items()} and want
    assert graphs.covering_page(a, p.where("fetched < 8"), 20, 12).count() == 0
    assert max(joined(got._jdf.queryExecution().executedPlan())) < 10_000  # the pairs are over 100,000


def joined(plan) -> list[int]:
    """The rows that each join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") else []
    return sum((joined(plan.children().apply(k)) for k in range(plan.children().size())), own)


def test_fits_of_many_components_stay_out_of_the_driver(spark, monkeypatch):
    """More pairs than LOCAL_PAIRS, but none in one component: no job for each round, nothing to the driver."""
    monkeypatch.setattr(P, "LOCAL_PAIRS", 40)
    rng = random.Random(9)
    batches = [(b, [[x] for x in rng.sample(range(b // 2 * 10, b // 2 * 10 + 6), 4)]) for b in range(40)] + [(99, [[900 + k] for k in range(12)])]
    p = P.pairs(spark.createDataFrame(batches, "batch long, tiers array<array<long>>"))
    called, rounds = [], P._davidson_rounds
    monkeypatch.setattr(P, "_davidson_rounds", lambda sides, parts, *rest: called.append({r["item"] for r in parts.collect()}) or rounds(sides, parts, *rest))
    fit = {r["item"]: r for r in P.davidson(p).collect()}
    assert called == [set(range(900, 912))] and fit[905].component == 900  # 66 pairs
    grad = dict.fromkeys(fit, 0.0)
    for r in p.collect():
        d = (fit[r.i].score - fit[r.j].score) / 2
        mean = (np.exp(d) + 0.5) / (np.exp(d) + np.exp(-d) + 1)
        grad[r.i] += r.w * (r.y - mean)
        grad[r.j] -= r.w * (r.y - mean)
    assert max(abs(g - P.REGULAR * fit[i].score) for i, g in grad.items()) < 1e-3
    monkeypatch.setattr(P, "LOCAL_PAIRS", 100_000)
    assert all(abs(r.score - fit[r["item"]].score) < 1e-3 for r in P.davidson(p).collect())


def roots(edges):
    """The least item that each item is connected to."""
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    return {x: top(x) for x in up}


def jobs(spark, name, run):
    """The number of Spark jobs that run starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_fit_over_separate_batches_starts_few_jobs(spark):
    """Each job adds to what the driver holds: batches that share no items need no rounds to find components."""
    p = P.pairs(spark.createDataFrame([(b, [[b * 9 + 5, b * 9 + 2], [b * 9 + 7], [b * 9]]) for b in range(200)], "batch long, tiers array<array<long>>").repartition(4))
    got = {}
    n = jobs(spark, "fit", lambda: got.update({r["item"]: r.component for r in P.davidson(p).collect()}))
    assert got == {b * 9 + k: b * 9 for b in range(200) for k in (0, 2, 5, 7)}
    assert n <= 25


def test_rounds_of_a_fit_leave_nothing_behind(spark, monkeypatch):
    monkeypatch.setattr(P, "LOCAL_PAIRS", 0)
    p = P.pairs(spark.createDataFrame([(b, [[b], [b + 1, b + 2], [b + 3]]) for b in range(40)], "batch long, tiers array<array<long>>")).localCheckpoint()
    runtime.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))

    def left(rounds):
        before = set(folder.iterdir())
        fit = P.davidson(p, rounds=rounds, tolerance=0.0, strict=False)
        return len(set(folder.iterdir()) - before), {r["item"]: r.score for r in fit.collect()}

    (few, _), (many, fit) = left(2), left(9)
    assert many <= few and many <= 10
    monkeypatch.setattr(P, "LOCAL_PAIRS", 100_000)
    local = {r["item"]: r.score for r in P.davidson(p, rounds=9, tolerance=0.0, strict=False).collect()}
    assert fit.keys() == local.keys() and all(abs(fit[i] - local[i]) < 1e-9 for i in fit)


@pytest.mark.parametrize("rows, items", [(100_000, 500_000), (50, 500_000), (50, 20), (1, 1)])
def test_forests_connect_what_the_pairs_do(monkeypatch, rows, items):
    import pyarrow as pa

    monkeypatch.setattr(P, "FOREST_ROWS", rows)
    monkeypatch.setattr(P, "FOREST_ITEMS", items)
    rng = random.Random(5)
    for kind in (lambda k: k * 7 - 900, lambda k: f"a{k}"):
        edges = [(kind(a), kind(rng.choice([a, a + 1, a + 40]))) for a in rng.choices(range(400), k=300)]
        batches = [pa.RecordBatch.from_pylist([{"i": i, "j": j} for i, j in edges[k : k + 30]]) for k in range(0, 300, 30)]
        out = [(r["i"], r["j"]) for b in P._forest(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert roots(out) == roots(edges) and all(i <= j for i, j in out)
        if items > 1000:
            assert {j: i for i, j in out} == roots(edges)
    assert not list(P._forest(iter([]))) and not list(P._forest(iter([batches[0].slice(0, 0)])))


@pytest.mark.parametrize("kind", ["first", "second"])
def test_rankings_keep_few_copies_of_wide_rows(spark, monkeypatch, kind):
    """What a ranking leaves in the checkpoint folder: a few copies of its rows, not one for each order."""
    monkeypatch.setattr(runtime, "CLEAR_AFTER", 2_000_000)
    rng = random.Random(10)
    day = lambda k: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k % 900)
    rows = [(f"a{k}", "gq"[k % 2], day(k * 7), day(2000), rng.randrange(50), rng.randrange(9), rng.randrange(4), k % 40, k % 32, rng.randbytes(2000).hex()) for k in range(1500)]
    df = spark.createDataFrame(rows, "asset string, rating string, created timestamp, observed timestamp, fav long, up long, down long, maker long, hints int, payload string").coalesce(4)
    runtime.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = held()
    if kind == "first":
        x = population.rank_first(df, population.Settings(least=50, makers=True))
        assert [r.ok for r in population.validate(x, ["main_rank", "rescue_rank"]).collect()] == [True] * 6
    else:
        x = population.rank_second(df, population.Settings(least=50, least_effective=20.0))
        assert sum(r.n for r in population.years(x).collect()) == 1500 and x.where("route <> 'rejected'").count() == 2 * (750 * 333 // 1000)
    assert held() - before < 4 * 1500 * 4000
    assert {r.asset: r.payload for r in x.select("asset", "payload").collect()} == {r[0]: r[-1] for r in rows}


def test_year_summary_numbers_few_rows_and_stores_no_wide_ones(spark, monkeypatch):
    """The summary of the second ranking's selection needs no row's rank, and features only once for rows that are alike."""
    monkeypatch.setattr(runtime, "CLEAR_AFTER", 1 << 40)
    rng = random.Random(11)
    day = lambda k: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k % 1300)
    kinds = [(rng.choice(["g", "q"]), day(k * 7), rng.choice([None, *range(50)]), rng.choice([None, *range(9)]), rng.randrange(4)) for k in range(500)] + [(None, day(5), 3, 1, 0), ("g", None, 7, 2, 1)]
    rows = [(f"a{k}", r, c, day(1299) + datetime.timedelta(days=400), f, u, d, k % 40, k % 32, rng.randbytes(2000).hex()) for k, (r, c, f, u, d) in enumerate(rng.choice(kinds) for _ in range(2000))]
    df = spark.createDataFrame(rows, "asset string, rating string, created timestamp, observed timestamp, fav long, up long, down long, maker long, hints int, payload string").coalesce(4)
    p = population.Settings(least=50, least_effective=20.0, penalty=3.0, time_down=0.1, eras=((1995, 1995, 2.0, 500), (1997, 1998, 1.0, None)))
    key = lambda r: (r.rating or "", r.created_year or 0)
    want = sorted(population.years(population.rank_second(df, p)).collect(), key=key)
    budget = sum(sum(x[1] == r for x in rows) * 333 // 1000 for r in "gq")
    monkeypatch.setattr(rankings, "_assets", lambda *_: df)
    monkeypatch.setattr(rankings, "SECOND", p)
    numbered, positions = [], population.positions
    monkeypatch.setattr(population, "positions", lambda rows_, *rest: numbered.append(rows_.count()) or positions(rows_, *rest))
    runtime.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = held()
    got = sorted(rankings.year_summary(spark, "").collect(), key=key)
    assert got == want and sum(r.n for r in got) == 2000 and sum(r.selected for r in got) == budget and any(r.penalised and r.fallback for r in got)
    assert held() - before < 2000 * 2000  # one copy of the wide column
    assert max(numbered) < 200
