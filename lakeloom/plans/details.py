"""Read-side queries: histories, overviews, capped records, duplicates, priors, boolean tag queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.functions import stats
from lakeloom.functions.top import first_k, first_rows
from lakeloom.operators import ranking as R
from lakeloom.plans.rankings import _POP, _heated, population
from lakeloom.sources.lake import LAKE_SQL, Lake, from_members

MAX_TAGS, MAX_GROUP = 128, 64


def tag_query(col: str, all_: list[str], any_: list[str], none: list[str]) -> Column | None:
    """A boolean tag query as a predicate, or None if it contradicts itself; it needs a positive tag."""
    groups = [sorted(set(g)) for g in (all_, any_, none)]
    if any(len(g) > MAX_GROUP for g in groups) or sum(map(len, groups)) > MAX_TAGS or not (groups[0] or groups[1]):
        raise ValueError("tag query")
    if set(groups[0]) & set(groups[2]) or (groups[1] and set(groups[1]) <= set(groups[2])):
        return None
    found, lits = F.split(F.col(col), " "), lambda g: F.array(*map(F.lit, g))
    parts = [F.array_contains(found, t) for t in groups[0]] + ([F.arrays_overlap(found, lits(groups[1]))] if groups[1] else []) + ([~F.arrays_overlap(found, lits(groups[2]))] if groups[2] else [])
    return reduce(lambda a, b: a & b, parts)


def boolean_tags(spark: SparkSession, d: str) -> DataFrame:
    p = tag_query("tag_string", ["single_subject"], ["full_frame", "rolled_cuffs"], ["outdoor_scene"])
    return from_members(spark, d).observations.where(p).select("row_id")


def _linked(lake: Lake, assets: DataFrame) -> DataFrame:
    some = assets.select("asset_id", F.col("row_id").alias("own"), F.col("post_id").alias("post"))
    o = lake.observations.select("row_id", "post_id", "commit_seq")
    origin = some.join(o, F.col("own") == F.col("row_id")).select("asset_id", "row_id", "commit_seq", F.lit("origin").alias("relation"))
    same = some.join(o, F.col("post") == F.col("post_id")).where("own <> row_id").select("asset_id", "row_id", "commit_seq", F.lit("same_post").alias("relation"))
    return origin.unionByName(same)


def history(spark: SparkSession, d: str) -> DataFrame:
    """The observations linked to each asset."""
    lake = from_members(spark, d)
    return _linked(lake, lake.assets)


def object_overview(spark: SparkSession, d: str) -> DataFrame:
    """Each object: its assets, posts, and its first three posts."""
    lake = from_members(spark, d)
    posts = lake.assets.where("sha256 IS NOT NULL AND post_id IS NOT NULL").select("sha256", "post_id").distinct()
    counts = lake.assets.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("assets"))
    few = first_k(posts, ["sha256"], [F.col("post_id")], 3, F.col("post_id"), "first_posts")
    return counts.join(posts.groupBy("sha256").agg(F.count("*").alias("posts")), "sha256", "left").join(few, "sha256", "left")


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """Assets that aren't the first of their object, with the first."""
    a = from_members(spark, d).assets.where("sha256 IS NOT NULL")
    first = a.groupBy("sha256").agg(F.min("asset_id").alias("first_asset"))
    return a.join(first, "sha256").where("asset_id <> first_asset").select("asset_id", F.col("first_asset").alias("duplicate_of"))


def raw_record(spark: SparkSession, d: str) -> DataFrame:
    """Items' records with a cap on their size in bytes: available, missing or too large."""
    i = spark.read.parquet(f"{d}/items.parquet").select("job_id", "post_id", "record_json").distinct()
    size = F.octet_length("record_json")
    status = F.when(size.isNull() | (size == 0), "missing").when(size > 200, "too_large").otherwise("available")
    return i.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.when(status == "available", size)).cast("long").alias("bytes"))


def maker_priors(spark: SparkSession, d: str) -> DataFrame:
    """Each order's prior from its customer's other orders within three years."""
    rows = stats.midranks(_heated(spark, d), ["rating"], "heat").where("heat IS NOT NULL")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    lo, hi = R.months_window(F.col("created"), 36)
    rows = rows.withColumns({"t": day(F.col("created")), "lo": day(lo), "hi": day(hi)})
    return R.maker_prior(rows, ["artist"], "t", "lo", "hi", "percentile", F.lit(0.5)).select("id", F.round("prior", 6).alias("prior"))


def _duplicates(policy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = population(spark, d).withColumn("family", F.floor(F.col("id") / 8))
        out = R.duplicate_heat(rows, "family", "id", "rating", "fav", "up", "created", policy)
        return out.select("family", "posts", F.col("heat").cast("double").alias("heat"), F.col("created").cast("string").alias("created"), "kinds_differ", F.array_join("evidence", ",").alias("evidence"))

    return query


def metric_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events' JSON metrics as maps, merged by adding each name's values."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_type", F.explode("m").alias("name", "value")).groupBy("event_type", "name").agg(F.sum("value").alias("total"), F.max("value").alias("most"))


def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each priority and status."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return first_rows(o, ["o_orderpriority", "o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


QUERIES = {
    "q_boolean_tags": boolean_tags, "q_history": history, "q_object_overview": object_overview, "q_representatives": representatives, "q_raw_record": raw_record, "q_maker_prior": maker_priors,
    "q_duplicate_heat_highest": _duplicates("highest"), "q_duplicate_heat_sum": _duplicates("sum"), "q_metric_merge": metric_merge, "q_top_rows": top_customers,
}
_HAS = "list_contains(string_split(tag_string, ' '), '{}')"
_DUP = f"""{_POP}, f AS (SELECT id // 8 AS family, count(*) AS posts, max(heat) AS best, sum(fav) AS fav, sum(up) AS up, min(created) AS created, min(rating) <> max(rating) AS kinds_differ FROM h GROUP BY 1),
e AS (SELECT family, string_agg(id::VARCHAR, ',' ORDER BY rn) AS evidence FROM (SELECT id // 8 AS family, id, row_number() OVER (PARTITION BY id // 8 ORDER BY heat DESC NULLS LAST, id) AS rn FROM h) WHERE rn <= 3 GROUP BY 1)
SELECT family, posts, ({{}})::DOUBLE AS heat, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, kinds_differ, evidence FROM f JOIN e USING (family)"""
SQL = {
    "q_boolean_tags": f"{LAKE_SQL} SELECT row_id FROM observations WHERE {_HAS.format('single_subject')} AND ({_HAS.format('full_frame')} OR {_HAS.format('rolled_cuffs')}) AND NOT {_HAS.format('outdoor_scene')}",
    "q_history": f"""{LAKE_SQL} SELECT a.asset_id, o.row_id, o.commit_seq, CASE WHEN o.row_id = a.row_id THEN 'origin' ELSE 'same_post' END AS relation
      FROM assets a JOIN observations o ON o.row_id = a.row_id UNION ALL SELECT a.asset_id, o.row_id, o.commit_seq, 'same_post' FROM assets a JOIN observations o ON o.post_id = a.post_id AND o.row_id <> a.row_id""",
    "q_object_overview": f"""{LAKE_SQL} SELECT sha256, count(*) AS assets, nullif(count(DISTINCT post_id), 0) AS posts, list_sort(list_distinct(list(post_id) FILTER (post_id IS NOT NULL)))[1:3] AS first_posts FROM assets WHERE sha256 IS NOT NULL GROUP BY 1""",
    "q_representatives": f"{LAKE_SQL} SELECT asset_id, duplicate_of FROM (SELECT asset_id, min(asset_id) OVER (PARTITION BY sha256) AS duplicate_of FROM assets WHERE sha256 IS NOT NULL) WHERE asset_id <> duplicate_of",
    "q_raw_record": """WITH i AS (SELECT DISTINCT job_id, post_id, record_json, strlen(record_json) AS n FROM items), s AS (SELECT *, CASE WHEN n IS NULL OR n = 0 THEN 'missing' WHEN n > 200 THEN 'too_large' ELSE 'available' END AS status FROM i)
      SELECT status, count(*) AS n, sum(CASE WHEN status = 'available' THEN n END)::BIGINT AS bytes FROM s GROUP BY 1""",
    "q_maker_prior": f"""{_POP}, p AS (SELECT id, artist, created, (rank() OVER (PARTITION BY rating ORDER BY heat) - 1 + count(*) OVER (PARTITION BY rating, heat) / 2) / count(*) OVER (PARTITION BY rating) AS p FROM h WHERE heat IS NOT NULL),
      w AS (SELECT x.id, count(y.id) AS n, coalesce(sum(y.p), 0) AS s FROM p x LEFT JOIN p y ON y.artist = x.artist AND y.id <> x.id AND y.created BETWEEN x.created - INTERVAL 36 MONTH AND x.created + INTERVAL 36 MONTH GROUP BY 1)
      SELECT id, round(CASE WHEN n >= 5 THEN greatest(0.0, least(1.0, ((s + 25) / (n + 50) - 0.5) / 0.2)) ELSE 0.0 END, 6) AS prior FROM w""",
    "q_duplicate_heat_highest": _DUP.format("best"),
    "q_duplicate_heat_sum": _DUP.format("(fav + 1)::HUGEINT * (up + 1)::HUGEINT"),
    "q_metric_merge": "SELECT event_type, k AS name, sum(v)::BIGINT AS total, max(v) AS most FROM (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events) e, LATERAL (SELECT (props ->> ('$.' || k))::BIGINT AS v) GROUP BY ALL",
    "q_top_rows": "SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
}
