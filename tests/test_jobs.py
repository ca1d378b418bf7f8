import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import population as P, vectors as V
from lakeloom.operators.rows import default_registry
from lakeloom.plans import jobs
from lakeloom.plans.spec import Condition, QuerySpec


def test_a_job_is_published_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None)], "ordinal long, value long")
    seen = []
    run = lambda df, **p: jobs.run_job(df, default_registry(), "scalar", 1, p, str(tmp_path), lambda a, b: seen.append(b.count() == a.count()))
    first = sorted(map(tuple, run(rows, multiply=2, add=1).collect()))
    again = sorted(map(tuple, run(rows.orderBy(F.desc("ordinal")), add=1, multiply=2).collect()))
    assert first == again == [(1, "available", 11, None), (2, "missing", None, None)] and seen == [True]
    run(rows, multiply=3, add=1)
    assert seen == [True, True]
    joined = jobs.with_input(run(rows, multiply=2, add=1).drop("value"), rows)
    assert sorted(map(tuple, joined.select("ordinal", "status", "value").collect()), key=lambda r: r[0]) == [(1, "available", 5), (2, "missing", None)]


def test_checks_stop_a_job(spark, tmp_path):
    def refuse(a, b):
        raise ValueError("bad output")

    rows = spark.createDataFrame([(1, 5)], "ordinal long, value long")
    with pytest.raises(ValueError):
        jobs.run_job(rows, default_registry(), "scalar", 1, {}, str(tmp_path), refuse)
    assert jobs.run_job(rows, default_registry(), "scalar", 1, {}, str(tmp_path)).count() == 1


def test_reuse_and_tiers(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert jobs.reused(spark, str(tmp_path), "k", make).count() == jobs.reused(spark, str(tmp_path), "k", make).count() == 3 and made == [1]
    rating, other = QuerySpec("current_post", (Condition("post.rating", "eq", ("g",)),)), QuerySpec("current_post", (Condition("post.score", "gte", ("1",)),))
    assert jobs.tier(rating).seconds is None and jobs.tier(other).seconds and jobs.needs_fence(rating) and not jobs.needs_fence(QuerySpec("current_post", (Condition("project.member", "eq", ("x",)),)))
    assert jobs.watermark({"a": 4, "b": 4}) == 4
    with pytest.raises(jobs.Changed):
        jobs.watermark({"a": 4, "b": 5})


def test_rating_bases_prune(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", "g"), (2, 1, "b", None), (3, 2, "c", "s")], "row_id long, post_id long, tag_string string, rating string")
    jobs.write_rating_bases(rows, f"{tmp_path}/bases")
    some = jobs.rating_base(spark, f"{tmp_path}/bases", ["g", "unknown"])
    assert sorted(r.row_id for r in some.collect()) == [1, 2]
    assert "PartitionFilters: [rating" in some._jdf.queryExecution().executedPlan().toString()


def test_recipes_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "g", 1, "main"), ("b", "g", 2, "audit"), ("c", "s", 1, "main")], "asset string, rating string, main_rank long, route string")
    assert {r.asset for r in jobs.recipe(rows, ratings=["g"], best=1).collect()} == {"a"}
    jobs.publish_view(rows, "ranking_members", routes=["main"])
    assert spark.sql("SELECT count(*) AS n FROM ranking_members").first().n == 2
    jobs.write_ranking(rows, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").where("rating = 's'").count() == 1
    data, digest = jobs.arrow_page(rows, 5, {"recipe": "x"})
    table = pa.ipc.open_stream(data).read_all()
    assert len(table) == 3 and table.schema.metadata[b"recipe"] == b"x" and len(digest) == 64
    with pytest.raises(ValueError):
        jobs.arrow_page(rows, 2, {})


def test_deadlines_and_scalar_inputs(spark):
    assert jobs.within(spark, 60, "quick", lambda: spark.range(5).count()) == 5
    slow = spark.range(4).mapInPandas(lambda it: (__import__("time").sleep(20) or b for b in it), "id long")
    with pytest.raises(Exception):
        jobs.within(spark, 1.0, "slow", slow.count)
    rows = spark.createDataFrame([(1, 7, None), (2, None, 3)], "ordinal long, length long, width long")
    assert [(r.status, r["value"]) for r in jobs.scalar_input(rows, "bytes").orderBy("ordinal").collect()] == [("available", 7), ("missing", None)]
    other = spark.createDataFrame([(2, "failed", None)], "ordinal long, status string, value long")
    assert [r.status for r in jobs.scalar_input(rows, "artifact", other).orderBy("ordinal").collect()] == ["missing", "failed"]


def test_vector_upkeep(spark):
    table = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"])], "object_id string, sources array<string>")
    found = spark.createDataFrame([("a", ["z", "x"]), ("b", ["y", "x"])], "object_id string, sources array<string>")
    assert sorted((r.object_id, r.sources, r.changed) for r in V.sources_updated(table, found, "object_id", "sources").collect()) == [("a", ["x", "z"], True), ("b", ["x", "y"], False)]
    assert V.kept_versions([(k, k * 100_000) for k in range(20)], {3}, 20 * 100_000) == [3, *range(12, 20)]
    done = spark.createDataFrame([("a", "p", True), ("a", "q", True), ("b", "p", False)], "object_id string, recipe string, ok boolean")
    assert [tuple(r) for r in V.planned(table.select("object_id"), done, ["p", "q"]).collect()] == [("b", ["p", "q"])]
    assert V.append_new(table, found.union(found), "object_id").count() == 0
    small = spark.createDataFrame([(1, 4), (2, 4), (3, 9), (4, 1), (5, 30), (6, 2)], "k int, size long")
    sums = {}
    for r in V.byte_batches(small, ["k"], "size", 10).collect():
        sums.setdefault(r.batch, []).append(r["size"])
    assert all(sum(x) <= 10 or len(x) == 1 for x in sums.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_against_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    rows = [(f"a{i:03d}", "g", int(rng.choice([1990, 1991, 1992, 1995])), int(d) + 1, int(r) + 1, int(m) + 1) for i, (d, r, m) in enumerate(zip(rng.permutation(n), rng.permutation(n), rng.permutation(n)))]
    p = P.Settings(keep=300, rescue=(100, 80), audit=50, eras=((1990, 1990, 0.0, 700), (1991, 1992, 0.0, 200)))
    df = spark.createDataFrame(rows, "asset string, rating string, created_year int, direct_rank long, rescue_rank long, main_rank long")
    got = {r.asset: r.route for r in P.select_second(df, p).collect()}
    import hashlib

    era = lambda y: 0 if y == 1990 else 1 if y in (1991, 1992) else 2
    budget = n * 300 // 1000
    room, free = P.targets(budget, [700, 200, 100], [sum(era(r[2]) == e for r in rows) for e in range(3)])
    want, used = dict.fromkeys((r[0] for r in rows), "rejected"), [0, 0, 0]
    key = lambda a: hashlib.sha256(b"audit\0" + len(b"seed-1").to_bytes(8, "big") + b"seed-1" + a.encode()).hexdigest()
    total = 0
    for route, order, ok, most in (
        ("rescue", lambda r: r[3], lambda r: r[3] <= budget < r[4], budget * 100 // 1000), ("rescue", lambda r: r[4], lambda r: r[4] <= budget < r[3], budget * 80 // 1000),
        ("main", lambda r: r[5], lambda r: True, None), ("audit", lambda r: key(r[0]), lambda r: True, None),
    ):
        most = budget - budget * 50 // 1000 - total if route == "main" else budget - total if route == "audit" else most
        got_ = 0
        for r in sorted(rows, key=order):
            if got_ < most and ok(r) and want[r[0]] == "rejected":
                e = era(r[2])
                if used[e] < room[e]:
                    used[e] += 1
                elif free > 0:
                    free -= 1
                else:
                    continue
                want[r[0]] = route
                got_ += 1
        total += got_
    assert got == want and total == budget
