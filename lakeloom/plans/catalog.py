"""Queries over the lake of the members and events tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.functions import tags
from lakeloom.plans import paging, scopes, versions
from lakeloom.plans.spec import Condition, QuerySpec, compile_spec, concat_sources, derived_filter, json_field
from lakeloom.sources.lake import LAKE_SQL, from_members, newest

C = Condition
EVENT_TYPES = ('click', 'error', 'purchase', 'signup', 'view')


def _spec(rule: str, *conditions: Condition):
    return lambda spark, d: compile_spec(QuerySpec(rule, conditions), from_members(spark, d))


def _spec_sql(rule: str, on_observation: str = "TRUE", on_object: str = "TRUE", prefix: str = "") -> str:
    if rule == "current_post":
        rows = f"SELECT a.sha256 FROM current_posts c JOIN assets a ON a.asset_id = c.asset_id JOIN observations o ON o.row_id = c.row_id WHERE {on_observation}"
    else:
        rows = f"""SELECT a.sha256 FROM assets a JOIN (SELECT DISTINCT post_id FROM observations o WHERE {on_observation}) o ON o.post_id = a.post_id
                   UNION ALL SELECT a.sha256 FROM assets a JOIN observations o ON o.row_id = a.row_id WHERE {on_observation}"""
    return f"{LAKE_SQL}{prefix} SELECT DISTINCT sha256 FROM objects WHERE {on_object} AND sha256 IN ({rows})"


_HAS = "list_contains(string_split(tag_string, ' '), '{}')"


def _events(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props", day.cast("long").alias("seq"))


_EVENTS = "WITH e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS seq FROM events)"


def current_events(spark: SparkSession, d: str) -> DataFrame:
    return newest(_events(spark, d), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


def json_field_events(spark: SparkSession, d: str) -> DataFrame:
    k = json_field("$.k")
    return _events(spark, d).where((k.column() >= 5) & (k.column() <= 40)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.column()).alias("k_sum"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return versions.post_intervals(from_members(spark, d).observations, ["rating", "score"]).select("post_id", "valid_from", "valid_until", "row_id", "rating", "score")


_INTERVALS_SQL = f"""{LAKE_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY post_id, commit_seq ORDER BY row_id DESC) AS rn FROM observations WHERE post_id IS NOT NULL)
SELECT post_id, commit_seq AS valid_from, lead(commit_seq) OVER (PARTITION BY post_id ORDER BY commit_seq) AS valid_until, row_id, rating, score FROM v WHERE rn = 1"""


def interval_read(spark: SparkSession, d: str) -> DataFrame:
    return versions.at(intervals(spark, d), 12).select("post_id", "row_id", "rating")


_DELTA_SPEC = QuerySpec("current_post", (C("post.rating", "in", ("g", "s")), C("post.score", "gte", ("30",))))


def as_of(spark: SparkSession, d: str) -> DataFrame:
    return compile_spec(_DELTA_SPEC, versions.as_of(from_members(spark, d), 15))


def delta(spark: SparkSession, d: str) -> DataFrame:
    """The result at commit 18 from that at commit 15; the SQL computes it from nothing."""
    lake = from_members(spark, d)
    return versions.delta(_DELTA_SPEC, lake, compile_spec(_DELTA_SPEC, versions.as_of(lake, 15)), 15, 18)


def _as_of_sql(seq: int) -> str:
    return f"""{LAKE_SQL}, cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY commit_seq DESC, row_id DESC) AS rn FROM observations WHERE post_id IS NOT NULL AND commit_seq <= {seq}) WHERE rn = 1)
    SELECT DISTINCT a.sha256 FROM cp JOIN assets a ON a.asset_id = cp.row_id WHERE cp.rating IN ('g', 's') AND cp.score >= 30 AND a.sha256 IS NOT NULL"""


def changed(spark: SparkSession, d: str) -> DataFrame:
    return versions.changed_objects(from_members(spark, d), 27, 30)


def member_versions(spark: SparkSession, d: str) -> DataFrame:
    lake = from_members(spark, d)
    results = [compile_spec(_DELTA_SPEC, versions.as_of(lake, s)) for s in (10, 20)]
    first = results[0].select("sha256", F.lit(1).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    return versions.member_intervals(first, results[1], 2)


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lake = from_members(spark, d)
    one = compile_spec(QuerySpec("any_observation", (C("post.rating", "eq", ("g",)),)), lake)
    return one, compile_spec(QuerySpec("any_observation", (C("post.score", "gte", ("50",)),)), lake)


_SETS = f""", one AS (SELECT DISTINCT sha256 FROM ({_spec_sql("any_observation", "rating = 'g'").split("SELECT DISTINCT sha256 FROM objects WHERE TRUE AND sha256 IN (")[1][:-1]}) WHERE sha256 IS NOT NULL),
two AS (SELECT DISTINCT sha256 FROM ({_spec_sql("any_observation", "score >= 50").split("SELECT DISTINCT sha256 FROM objects WHERE TRUE AND sha256 IN (")[1][:-1]}) WHERE sha256 IS NOT NULL)"""


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key")).where("key % 2 = 0")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    edits = orders.groupBy(F.col("o_custkey").alias("key")).agg((F.min("o_orderkey") % 9).cast("int").alias("since"), (F.count("*") % 3 != 0).alias("present"))
    return base, edits.withColumn("until", F.when(F.col("key") % 4 == 0, F.col("since") + 3))


def workset_revision(spark: SparkSession, d: str) -> DataFrame:
    base, edits = _edits(spark, d)
    return scopes.at_revision(base, edits, ["key"], 5)


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    one, two = _sets(spark, d)
    return concat_sources({"first": one, "second": two})


def source_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of two sources merged, by post id downwards, unknown posts last, after a cursor."""
    lake = from_members(spark, d)
    rows = lake.assets.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("post_id").alias("post_id")).withColumnRenamed("sha256", "asset_id")
    parts = [rows.where(F.col("asset_id") < "8").withColumn("source_id", F.lit("a")), rows.where(F.col("asset_id") >= "8").withColumn("source_id", F.lit("b"))]
    keys = [("post_id", True), ("source_id", False), ("asset_id", True)]
    return paging.page(paging.merged(parts), keys, 48, {"post_id": 1500, "source_id": "a", "asset_id": "f"}).select("post_id", "source_id", "asset_id")


def ranked_positions(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 orders of each priority by price."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return paging.positions(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_orderpriority"]).where("position <= 20")


def tag_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return tags.dictionary(from_members(spark, d).observations, "tag_string")


def tag_postings(spark: SparkSession, d: str) -> DataFrame:
    return tags.postings(from_members(spark, d).observations, "row_id", "tag_string").groupBy("row_id").agg(F.count("*").alias("n"), F.min("tag").alias("first_tag"))


def tag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Postings that only one of two commits' current posts has."""
    lake = from_members(spark, d)
    at = lambda s: versions.as_of(lake, s)
    now = [lk.current_posts.select("row_id", "post_id").join(lk.observations.select("row_id", "tag_string"), "row_id") for lk in (at(20), at(21))]
    return scopes.multiset_difference(*[tags.postings(x, "post_id", "tag_string") for x in now])


def tag_mask(spark: SparkSession, d: str) -> DataFrame:
    hint = tags.mask("tag_string", {"single_subject": 1, "full_frame": 2, "soft_shading": 4, "outdoor_scene": 8})
    return from_members(spark, d).observations.where("tag_string IS NOT NULL").groupBy(hint.alias("hints")).agg(F.count("*").alias("n"))


def tag_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose observations spell different tag sets."""
    o = from_members(spark, d).observations.where("post_id IS NOT NULL")
    return o.groupBy("post_id").agg(F.countDistinct(tags.fingerprint("tag_string")).alias("tag_sets")).where("tag_sets > 1")


def scalar_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose scalar column (some missing, some failed, some never computed) is at least 30."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    status = F.when(F.col("p_size") % 7 == 0, "missing").when(F.col("p_size") % 11 == 0, "failed").otherwise("available")
    column = parts.where("p_partkey % 3 <> 0").select("p_partkey", status.alias("status"), F.col("p_size").cast("long").alias("value"))
    return derived_filter(parts.select("p_partkey"), column, "p_partkey", "gte", 30)


def shared_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that several posts have: how many, and the first three."""
    a = from_members(spark, d).assets.where("sha256 IS NOT NULL AND post_id IS NOT NULL").select("sha256", "post_id").distinct()
    per = a.groupBy("sha256").agg(F.count("*").alias("posts"), F.min("post_id").alias("first_post"))
    return per.where("posts > 1")


def covering_pages(spark: SparkSession, d: str) -> DataFrame:
    """The freshest page over each event's place; parts are pages."""
    from lakeloom.operators.graphs import covering_page

    types = F.array(*map(F.lit, EVENT_TYPES))
    parts = spark.read.parquet(f"{d}/part.parquet")
    lower = (F.col("p_size") * 10).cast("long")
    pages = parts.select(F.col("p_partkey").alias("page_id"), F.element_at(types, (F.col("p_partkey") % 5 + 1).cast("int")).alias("scope"), lower.alias("lower"), (lower + 25).alias("through"), (F.col("p_partkey") * 37 % 1000).alias("fetched"))
    asks = _events(spark, d).select(F.col("event_id").alias("ask_id"), F.col("event_type").alias("scope"), (F.col("event_id") % 600).alias("x"))
    return covering_page(asks, pages, 1000, 400)


QUERIES = {
    "q_rating_current": _spec("current_post", C("post.rating", "in", ("g", "e"))),
    "q_rating_any": _spec("any_observation", C("post.rating", "in", ("g", "e"))),
    "q_same_observation": _spec("any_observation", C("post.score", "gte", ("40",)), C("image.width", "gte", ("1500",)), C("post.rating", "ne", ("e",))),
    "q_tag_has": _spec("current_post", C("post.tags", "has_tag", ("single_subject",))),
    "q_tags_all": _spec("any_observation", C("post.tags", "has_all_tags", ("single_subject", "full_frame"))),
    "q_tags_any": _spec("current_post", C("post.tags", "has_any_tags", ("soft_shading", "shut_lips"))),
    "q_tags_none": _spec("current_post", C("post.tags", "has_no_tags", ("single_subject", "gaze_elsewhere"))),
    "q_tags_missing": _spec("any_observation", C("post.tags", "is_missing")),
    "q_rating_missing": _spec("current_post", C("post.rating", "is_missing"), C("post.deleted", "eq", ("false",))),
    "q_stored_fields": _spec("any_observation", C("stored.extension", "is_present"), C("stored.length", "lte", ("20000",)), C("post.score", "lte", ("20",))),
    "q_catalog_scan": _spec("any_observation", C("stored.length", "gte", ("60000",))),
    "q_current_events": current_events,
    "q_json_field": json_field_events,
    "q_intervals": intervals,
    "q_interval_read": interval_read,
    "q_as_of": as_of,
    "q_changed_objects": changed,
    "q_delta": delta,
    "q_member_versions": member_versions,
    "q_scope_add": lambda s, d: scopes.add(*_sets(s, d), ["sha256"]),
    "q_scope_remove": lambda s, d: scopes.remove(*_sets(s, d), ["sha256"]),
    "q_scope_intersect": lambda s, d: scopes.intersect(*_sets(s, d), ["sha256"]),
    "q_directory_delta": lambda s, d: scopes.directory_delta(*_sets(s, d), ["sha256"]).groupBy("state").agg(F.count("*").alias("n")),
    "q_workset_revision": workset_revision,
    "q_two_sources": two_sources,
    "q_source_page": source_page,
    "q_positions": ranked_positions,
    "q_tag_dictionary": tag_dictionary,
    "q_tag_postings": tag_postings,
    "q_tag_diff": tag_diff,
    "q_tag_mask": tag_mask,
    "q_tag_sets": tag_fingerprints,
    "q_scalar_filter": scalar_filter,
    "q_shared_objects": shared_objects,
    "q_covering_page": covering_pages,
}
_TOKENS = "list_sort(list_distinct([x for x in string_split(tag_string, ' ') if x <> '']))"
_POSTED = lambda seq: f"SELECT unnest({_TOKENS}) AS tag, post_id FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY commit_seq DESC, row_id DESC) AS rn FROM observations WHERE post_id IS NOT NULL AND commit_seq <= {seq}) WHERE rn = 1"
SQL = {
    "q_rating_current": _spec_sql("current_post", "rating IN ('g', 'e')"),
    "q_rating_any": _spec_sql("any_observation", "rating IN ('g', 'e')"),
    "q_same_observation": _spec_sql("any_observation", "score >= 40 AND width >= 1500 AND rating <> 'e'"),
    "q_tag_has": _spec_sql("current_post", _HAS.format("single_subject")),
    "q_tags_all": _spec_sql("any_observation", "list_has_all(string_split(tag_string, ' '), ['single_subject', 'full_frame'])"),
    "q_tags_any": _spec_sql("current_post", "list_has_any(string_split(tag_string, ' '), ['soft_shading', 'shut_lips'])"),
    "q_tags_none": _spec_sql("current_post", "NOT list_has_any(string_split(tag_string, ' '), ['single_subject', 'gaze_elsewhere'])"),
    "q_tags_missing": _spec_sql("any_observation", "tag_string IS NULL"),
    "q_rating_missing": _spec_sql("current_post", "rating IS NULL AND is_deleted = FALSE"),
    "q_stored_fields": _spec_sql("any_observation", "score <= 20", "stored_ext IS NOT NULL AND length <= 20000"),
    "q_catalog_scan": f"{LAKE_SQL} SELECT sha256 FROM objects WHERE length >= 60000",
    "q_current_events": f"{_EVENTS} SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM e) WHERE rn = 1",
    "q_json_field": f"{_EVENTS}, k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM e) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k_sum FROM k WHERE k BETWEEN 5 AND 40 GROUP BY 1",
    "q_intervals": _INTERVALS_SQL,
    "q_interval_read": f"SELECT post_id, row_id, rating FROM ({_INTERVALS_SQL}) WHERE valid_from <= 12 AND (valid_until IS NULL OR valid_until > 12)",
    "q_as_of": _as_of_sql(15),
    "q_delta": _as_of_sql(18),
    "q_changed_objects": f"""{LAKE_SQL}, f AS (SELECT * FROM observations WHERE commit_seq > 27 AND commit_seq <= 30)
      SELECT DISTINCT sha256 FROM assets WHERE sha256 IS NOT NULL AND (row_id IN (SELECT row_id FROM f) OR post_id IN (SELECT post_id FROM f WHERE post_id IS NOT NULL))""",
    "q_member_versions": f"WITH a AS ({_as_of_sql(10)}), b AS ({_as_of_sql(20)}) SELECT coalesce(a.sha256, b.sha256) AS sha256, CASE WHEN a.sha256 IS NULL THEN 2 ELSE 1 END AS since, CASE WHEN b.sha256 IS NULL THEN 2 END AS until FROM a FULL JOIN b ON a.sha256 = b.sha256",
    "q_scope_add": f"{LAKE_SQL}{_SETS} SELECT sha256 FROM one UNION SELECT sha256 FROM two",
    "q_scope_remove": f"{LAKE_SQL}{_SETS} SELECT sha256 FROM one EXCEPT SELECT sha256 FROM two",
    "q_scope_intersect": f"{LAKE_SQL}{_SETS} SELECT sha256 FROM one INTERSECT SELECT sha256 FROM two",
    "q_directory_delta": f"{LAKE_SQL}{_SETS} SELECT CASE WHEN one.sha256 IS NULL THEN 'added' WHEN two.sha256 IS NULL THEN 'gone' ELSE 'unchanged' END AS state, count(*) AS n FROM one FULL JOIN two ON one.sha256 = two.sha256 GROUP BY 1",
    "q_workset_revision": """WITH e AS (SELECT o_custkey AS key, (min(o_orderkey) % 9)::INT AS since, count(*) % 3 <> 0 AS present FROM orders GROUP BY 1),
      v AS (SELECT * FROM e WHERE since <= 5 AND (key % 4 <> 0 OR since + 3 > 5)), base AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0)
      SELECT key FROM base WHERE key NOT IN (SELECT key FROM v) UNION SELECT key FROM v WHERE present""",
    "q_two_sources": f"{LAKE_SQL}{_SETS} SELECT 'first' AS source_id, sha256 AS asset_id FROM one UNION ALL SELECT 'second', sha256 FROM two",
    "q_source_page": f"""{LAKE_SQL}, r AS (SELECT sha256 AS asset_id, min(post_id) AS post_id, CASE WHEN sha256 < '8' THEN 'a' ELSE 'b' END AS source_id FROM assets WHERE sha256 IS NOT NULL GROUP BY sha256)
      SELECT post_id, source_id, asset_id FROM r WHERE post_id IS NULL OR post_id < 1500 OR (post_id = 1500 AND (source_id > 'a' OR (source_id = 'a' AND asset_id < 'f'))) ORDER BY post_id DESC NULLS LAST, source_id, asset_id DESC LIMIT 49""",
    "q_positions": "SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 20",
    "q_tag_dictionary": f"{LAKE_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS tag FROM observations) GROUP BY tag",
    "q_tag_postings": f"{LAKE_SQL} SELECT row_id, count(*) AS n, min(tag) AS first_tag FROM (SELECT row_id, unnest({_TOKENS}) AS tag FROM observations) GROUP BY row_id",
    "q_tag_diff": f"{LAKE_SQL}, a AS ({_POSTED(20)}), b AS ({_POSTED(21)}) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "q_tag_mask": f"{LAKE_SQL} SELECT " + " + ".join(f"CASE WHEN {_HAS.format(t)} THEN {b} ELSE 0 END" for t, b in (("single_subject", 1), ("full_frame", 2), ("soft_shading", 4), ("outdoor_scene", 8))) + " AS hints, count(*) AS n FROM observations WHERE tag_string IS NOT NULL GROUP BY 1",
    "q_tag_sets": f"{LAKE_SQL} SELECT post_id, count(DISTINCT {_TOKENS}::VARCHAR) AS tag_sets FROM observations WHERE post_id IS NOT NULL GROUP BY 1 HAVING tag_sets > 1",
    "q_scalar_filter": "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size >= 30",
    "q_shared_objects": f"{LAKE_SQL} SELECT sha256, count(DISTINCT post_id) AS posts, min(post_id) AS first_post FROM assets WHERE sha256 IS NOT NULL AND post_id IS NOT NULL GROUP BY 1 HAVING posts > 1",
    "q_covering_page": f"""WITH p AS (SELECT p_partkey AS page_id, {list(EVENT_TYPES)}[p_partkey % 5 + 1] AS scope, p_size * 10 AS lower_, p_partkey * 37 % 1000 AS fetched FROM part)
      SELECT event_id AS ask_id, arg_max(page_id, (fetched, page_id)) AS page_id FROM events JOIN p ON scope = event_type AND event_id % 600 >= lower_ AND event_id % 600 < lower_ + 25 WHERE fetched >= 600 GROUP BY 1""",
}
