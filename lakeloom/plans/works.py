"""Works with pages and their read side: a second source family over orders and lines, recency winners of
duplicate records, overviews, pages and inventories, each with its SQL.

Works are orders, their pages (media) are lines, an asset is a line's part from its supplier, and objects
are assets of one content. All relations are derived lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.functions.top import first_k, first_rows
from lakeloom.plans import paging
from lakeloom.plans.spec import Condition, QuerySpec, compile_spec
from lakeloom.sources.lake import LAKE_SQL, Lake, from_members, newest

OBJECTS = 4093  # contents that assets share


@dataclass(frozen=True)
class WorkLake:
    """works(work_id, author_id, kind, rating, created), current_works(author_id, kind, work_id),
    media(work_id, ordinal, media_id), media_assets(media_id, asset_id, at), current_media_assets(media_id,
    asset_id), assets(asset_id, sha256)."""

    works: DataFrame
    current_works: DataFrame
    media: DataFrame
    media_assets: DataFrame
    current_media_assets: DataFrame
    assets: DataFrame


def normalised(orders: DataFrame, lines: DataFrame) -> WorkLake:
    """The relations of a work source from its two raw tables."""
    works = orders.select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("rating"), F.col("o_orderdate").alias("created"))
    current = newest(works, ["author_id", "kind"], ["created", "work_id"], ["work_id"])
    media = lines.select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("media_id"))
    asset = (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("asset_id")
    held = lines.select(F.col("l_partkey").alias("media_id"), asset, F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    latest = held.groupBy("media_id").agg(F.max_by("asset_id", "at").alias("asset_id"))
    return WorkLake(works, current, media, held, latest, held.select("asset_id", F.sha2((F.col("asset_id") % OBJECTS).cast("string"), 256).alias("sha256")).distinct())


def work_lake(spark: SparkSession, d: str) -> WorkLake:
    return normalised(spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet"))


def current_rule(w: WorkLake, where: Column) -> DataFrame:
    """(sha256) of objects that are the current asset of a page of a current work that matches."""
    works = w.works.where(where).join(w.current_works.select("work_id"), "work_id", "left_semi").select("work_id")
    media = w.media.join(works, "work_id", "left_semi").select("media_id")
    assets = w.current_media_assets.join(media, "media_id", "left_semi").select("asset_id")
    return w.assets.join(assets, "asset_id", "left_semi").select("sha256").distinct()


def any_rule(w: WorkLake, where: Column) -> DataFrame:
    """(sha256) of objects of any asset of a page of any work that matches."""
    media = w.media.join(w.works.where(where).select("work_id"), "work_id", "left_semi").select("media_id")
    assets = w.media_assets.join(media, "media_id", "left_semi").select("asset_id")
    return w.assets.join(assets, "asset_id", "left_semi").select("sha256").distinct()


def _paged(w: WorkLake) -> DataFrame:
    """(sha256, work_id, ordinal) of the current asset of every page."""
    return w.media.join(w.current_media_assets, "media_id").join(w.assets, "asset_id").select("sha256", "work_id", "ordinal")


def first_page(spark: SparkSession, d: str) -> DataFrame:
    """Each object's least work and page."""
    least = _paged(work_lake(spark, d)).groupBy("sha256").agg(F.min(F.struct("work_id", "ordinal")).alias("m"))
    return least.select("sha256", "m.work_id", "m.ordinal")


def object_works(spark: SparkSession, d: str) -> DataFrame:
    """Each object: its works and authors, and the kinds of works in order."""
    w = work_lake(spark, d)
    x = _paged(w).select("sha256", "work_id").distinct().join(w.works, "work_id")
    return x.groupBy("sha256").agg(F.count("*").alias("works"), F.countDistinct("author_id").alias("authors"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))


def author_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages of the two newest works of every author."""
    w = work_lake(spark, d)
    few = first_rows(w.works.select("author_id", "work_id", "created"), ["author_id"], [F.col("created").desc(), F.col("work_id")], 2).select("author_id", "work_id", "place")
    pages = first_rows(w.media.select("work_id", "ordinal", "media_id").join(few.select("work_id"), "work_id", "left_semi"), ["work_id"], [F.col("ordinal"), F.col("media_id")], 2).select("work_id", "ordinal", "media_id")
    return few.join(pages, "work_id").select("author_id", "place", "work_id", "ordinal", "media_id")


# --- recency winners of duplicate records -----------------------------------------------------------


def records(lake: Lake) -> DataFrame:
    """(ordinal, row_id, post_id, rating, score, day, at, updated, priority, coarse) of each image's records;
    a record that only knows its day makes its image's whole day coarse."""
    r = F.col("row_id")
    at = F.col("commit_seq") * 86_400 + r % 86_400
    x = lake.assets.select("row_id", F.col("sha256").alias("ordinal")).where("ordinal IS NOT NULL").join(lake.observations, "row_id")
    x = x.select("ordinal", "row_id", "post_id", "rating", "score", F.col("commit_seq").alias("day"), at.alias("at"), F.when(r % 3 > 0, r % 19).alias("updated"), (r % 4).alias("priority"), (r % 13 == 0).alias("date_only"))
    days = x.groupBy(F.col("ordinal").alias("__o"), F.col("day").alias("__d")).agg(F.max("date_only").alias("coarse"))
    return x.join(days, (F.col("ordinal") == F.col("__o")) & (F.col("day") == F.col("__d"))).drop("__o", "__d", "date_only")


#: The later record of an image: by day, moment (unless the day is coarse), update, source, then number.
RECENCY = ["day", "fine", "updated", "priority", "back"]


def latest(rows: DataFrame, key: list[str], first: Column | None = None) -> DataFrame:
    """The latest record of each key by RECENCY; first: what counts before it, greatest first."""
    x = rows.withColumns({"fine": F.when(~F.col("coarse"), F.col("at")), "back": -F.col("row_id"), "__first": F.lit(0) if first is None else first})
    keep = [c for c in rows.columns if c not in key]
    return newest(x, key, ["__first", *RECENCY], keep)


def _post_key() -> Column:
    return F.when(F.col("post_id").isNull(), F.concat(F.lit("record:"), F.col("row_id").cast("string"))).otherwise(F.concat(F.lit("post:"), F.col("post_id").cast("string")))


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each image and post."""
    x = records(from_members(spark, d)).withColumn("post_key", _post_key())
    return latest(x, ["ordinal", "post_key"]).select("ordinal", "post_key", "row_id", "coarse")


def metadata_winners(spark: SparkSession, d: str) -> DataFrame:
    """Of each image's latest records the latest one, and the one of a wanted rating if there is any."""
    x = latest(records(from_members(spark, d)).withColumn("post_key", _post_key()), ["ordinal", "post_key"])
    newest_, legacy = latest(x, ["ordinal"]), latest(x, ["ordinal"], F.when(F.col("rating").isin("g", "s"), 1).otherwise(0))
    return newest_.select("ordinal", F.col("row_id").alias("newest")).join(legacy.select("ordinal", F.col("row_id").alias("legacy")), "ordinal")


# --- read side ---------------------------------------------------------------------------------------


def origin_width(spark: SparkSession, d: str) -> DataFrame:
    """Of each object the width that the first asset's own observation tells, or that it's missing."""
    lake = from_members(spark, d)
    first = lake.assets.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("asset_id", "row_id")).alias("a")).select("sha256", "a.row_id")
    o = lake.observations.select("row_id", F.when(F.col("row_id") % 7 > 0, F.col("width")).alias("width"))
    x = first.join(o, "row_id", "left")
    return x.select("sha256", F.when(F.col("width").isNull(), "missing").otherwise("available").alias("status"), "width")


def stored_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """How many events have a usable size: from their value, else from their JSON, else not recorded."""
    usable = lambda c: F.when((c > 0) & (c <= 2**32 - 1), c)
    own = usable(F.when(F.col("value") >= 50, F.floor("value").cast("bigint")))
    raw = usable(F.get_json_object("props", "$.k").try_cast("bigint"))
    basis = F.when(own.isNotNull(), "details").when(raw.isNotNull(), "raw").otherwise("not recorded")
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", basis.alias("basis")).agg(F.count("*").alias("n"), F.sum(F.coalesce(own, raw)).alias("total"))


def pin_overview(spark: SparkSession, d: str) -> DataFrame:
    """Each image of the pins: pins, scans, boards, and its first three pins."""
    x = spark.read.parquet(f"{d}/pinterest_stream_pins.parquet").where("image_signature IS NOT NULL").select("image_signature", "pin_id", "scan_id", "board_id")
    counts = x.groupBy("image_signature").agg(F.countDistinct("pin_id").alias("pins"), F.countDistinct("scan_id").alias("scans"), F.countDistinct("board_id").alias("boards"))
    few = first_k(x.where("pin_id IS NOT NULL").select("image_signature", "pin_id").distinct(), ["image_signature"], [F.col("pin_id")], 3, F.col("pin_id"), "first_pins")
    return counts.join(few, "image_signature", "left").select("image_signature", "pins", "scans", "boards", F.array_join("first_pins", ",").alias("first_pins"))


def project_objects(spark: SparkSession, d: str) -> DataFrame:
    """A page of all kinds of objects whose name holds a text, by name and id, after a cursor."""
    of = lambda t, k, n: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("id"), F.col(n).alias("name"))
    rows = of("supplier", "s_suppkey", "s_name").unionByName(of("customer", "c_custkey", "c_name")).unionByName(of("part", "p_partkey", "p_name")).where(F.contains(F.lower("name"), F.lit("r")))
    return paging.page(rows, [("name", False), ("kind", False), ("id", False)], 60, {"name": "Customer#000000005", "kind": "customer", "id": 0})


def references(spark: SparkSession, d: str) -> DataFrame:
    """What each part is linked to, by the type of link, each link once."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    part = F.col("l_partkey").alias("part")
    links = lines.select(part, F.lit("supplier").alias("type"), F.col("l_suppkey").alias("target")).unionByName(lines.select(part, F.lit("order").alias("type"), F.col("l_orderkey").alias("target")))
    links = links.unionByName(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(part, F.lit("customer").alias("type"), F.col("o_custkey").alias("target")))
    return links.distinct().groupBy("part", "type").agg(F.count("*").alias("n"), F.min("target").alias("first"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """A page of candidates by rating and exposure, then key."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("exposure"))
    return paging.page(o.where("o_orderstatus IN ('F', 'O') AND exposure >= 20"), [("exposure", False), ("o_orderkey", False)], 100, {"exposure": 40, "o_orderkey": 0}).select("o_orderkey", "o_orderstatus", "exposure")


def cache_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Families of cached results: members, users, and bytes shared out among those who hold the same member."""
    x = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("family"), F.col("user_id").alias("member"), F.octet_length("props").alias("size"))
    held = x.groupBy("family", "member").agg(F.sum("size").alias("size"))
    share = held.groupBy(F.col("member").alias("__m")).agg(F.count("*").alias("holders"))
    y = held.join(share, F.col("member") == F.col("__m"))
    return y.groupBy("family").agg(F.count("*").alias("members"), F.sum(F.when(F.col("holders") > 1, 1).otherwise(0)).alias("shared"), F.round(F.sum(F.col("size") / F.col("holders")), 4).alias("bytes"))


def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each flag is set on an order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50_000, F.lit("cheap")), F.when(F.col("o_orderstatus") == "P", F.lit("partial")), F.when(F.month("o_orderdate") == 12, F.lit("december"))))
    return o.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def consensus(spark: SparkSession, d: str) -> DataFrame:
    """What the works of each author agree on: their one known rating, none known, or a conflict; first year."""
    w = work_lake(spark, d).works.withColumn("known", F.when(F.col("rating") != "P", F.col("rating")))
    g = w.groupBy("author_id").agg(F.countDistinct("known").alias("k"), F.min("known").alias("r"), F.min(F.year("created")).alias("first_year"))
    return g.select("author_id", F.when(F.col("k") == 0, "unknown").when(F.col("k") > 1, "conflict").otherwise(F.col("r")).alias("rating"), "first_year")


def batch_states(spark: SparkSession, d: str) -> DataFrame:
    """Batches by round and state, and the totals of their receipts; a reversed receipt counts against."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return lines.groupBy(F.year("l_shipdate").alias("round"), F.col("l_linestatus").alias("state")).agg(F.countDistinct("l_orderkey").alias("batches"), F.sum(sign * F.col("l_quantity")).cast("long").alias("used"))


def retries(spark: SparkSession, d: str) -> DataFrame:
    """The next 200 items to try again: due, fewer than 8 attempts, by time and key."""
    i = spark.read.parquet(f"{d}/items.parquet").select("job_id", "post_id", "state", "attempts", "retry_at").distinct()
    due = i.where("retry_at IS NOT NULL AND attempts < 8 AND job_id IS NOT NULL AND post_id IS NOT NULL").groupBy("job_id", "post_id").agg(F.min("retry_at").alias("retry_at"))
    return due.orderBy("retry_at", "job_id", "post_id").limit(200)


def row_range(spark: SparkSession, d: str) -> DataFrame:
    """Objects of 32,768 rows after a cursor that match: a scan that can go on where it ended."""
    lake = from_members(spark, d)
    rows = lake.assets.where("asset_id > 100 AND asset_id <= 100 + 32768").select("asset_id", "row_id", "sha256")
    matching = lake.observations.where("rating = 'g' AND score >= 30").select("row_id")
    return rows.join(matching, "row_id", "left_semi").select("asset_id", "sha256")


def unknown_tags(spec: QuerySpec, dictionary: DataFrame) -> QuerySpec | None:
    """The spec without what unknown tags make true, or None if they make it impossible. Only the tags that
    the spec names (at most a few hundred) are looked up."""
    asked = sorted({t for c in spec.conditions if c.op.startswith("has_") for t in c.value})
    known = {r[0] for r in dictionary.where(F.col("tag").isin(asked)).select("tag").collect()} if asked else set()
    out = []
    for c in spec.conditions:
        if c.op in ("has_tag", "has_all_tags") and not set(c.value) <= known or c.op == "has_any_tags" and not set(c.value) & known:
            return None
        if c.op in ("has_any_tags", "has_no_tags"):
            values = tuple(v for v in c.value if v in known)
            out.append(Condition(c.field, c.op, values) if values else Condition(c.field, "is_present"))
        else:
            out.append(c)
    return QuerySpec(spec.rule, tuple(out), spec.sources)


def known_tags(spark: SparkSession, d: str) -> DataFrame:
    from lakeloom.functions import tags

    lake = from_members(spark, d)
    spec = QuerySpec("any_observation", (Condition("post.tags", "has_no_tags", ("never_used_tag",)), Condition("post.tags", "has_any_tags", ("never_used_tag", "single_subject"))))
    return compile_spec(unknown_tags(spec, tags.dictionary(lake.observations, "tag_string")), lake)


def snapshot_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of a preference snapshot (parts by brand and price): brands, the best fifth by tied rank (at least one
    row, ties counted from their first place), exposures, and all protected rows."""
    from lakeloom.operators.preference import tied_ranks

    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_size", F.col("p_size").cast("double").alias("score"))
    x = tied_ranks(parts, ["p_brand"], "score")
    sizes = parts.groupBy(F.col("p_brand").alias("__b")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.2)).alias("most"))
    x = x.join(sizes, F.col("p_brand") == F.col("__b"))
    best = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21", "Brand#31") & (F.col("lo") <= F.col("most")) & (F.col("p_partkey") % 5 > 0)
    return x.where(best | (F.col("p_partkey") % 17 == 0)).select("p_partkey", "lo", "hi")


QUERIES = {
    "q_works_current": lambda s, d: current_rule(work_lake(s, d), F.col("rating") == "O"), "q_works_any": lambda s, d: any_rule(work_lake(s, d), F.col("kind") == "1-URGENT"),
    "q_first_page": first_page, "q_object_works": object_works, "q_author_pages": author_pages, "q_latest_records": latest_records, "q_metadata_winners": metadata_winners,
    "q_origin_width": origin_width, "q_stored_dimensions": stored_dimensions, "q_pin_overview": pin_overview, "q_project_objects": project_objects, "q_references": references,
    "q_candidates": candidates, "q_cache_inventory": cache_inventory, "q_flag_histogram": flag_histogram, "q_consensus": consensus, "q_batch_states": batch_states, "q_retries": retries,
    "q_row_range": row_range, "q_known_tags": known_tags, "q_snapshot_filter": snapshot_filter,
}
_WORKS = f"""WITH works AS (SELECT o_orderkey AS work_id, o_custkey AS author_id, o_orderpriority AS kind, o_orderstatus AS rating, o_orderdate AS created FROM orders),
current_works AS (SELECT * FROM works QUALIFY row_number() OVER (PARTITION BY author_id, kind ORDER BY created DESC, work_id DESC) = 1),
media AS (SELECT l_orderkey AS work_id, l_linenumber AS ordinal, l_partkey AS media_id FROM lineitem),
held AS (SELECT l_partkey AS media_id, l_partkey * 100000 + l_suppkey AS asset_id, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
cma AS (SELECT media_id, asset_id FROM held QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
assets AS (SELECT DISTINCT asset_id, sha256((asset_id % {OBJECTS})::VARCHAR) AS sha256 FROM held)"""
_RECENT = f"""{LAKE_SQL}, x AS (SELECT a.sha256 AS ordinal, o.*, commit_seq * 86400 + o.row_id % 86400 AS moment, CASE WHEN o.row_id % 3 > 0 THEN o.row_id % 19 END AS updated, o.row_id % 4 AS priority,
  max(CASE WHEN o.row_id % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a.sha256, commit_seq) AS coarse FROM assets a JOIN observations o USING (row_id) WHERE a.sha256 IS NOT NULL),
k AS (SELECT *, CASE WHEN post_id IS NULL THEN 'record:' || row_id ELSE 'post:' || post_id END AS post_key FROM x),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ordinal, post_key ORDER BY commit_seq DESC, CASE WHEN coarse = 0 THEN moment END DESC NULLS LAST, updated DESC NULLS LAST, priority DESC, row_id) = 1)"""
_ORDER = "commit_seq DESC, CASE WHEN coarse = 0 THEN moment END DESC NULLS LAST, updated DESC NULLS LAST, priority DESC, row_id"
_HAS = "list_contains(string_split(tag_string, ' '), '{}')"
SQL = {
    "q_works_current": f"{_WORKS} SELECT DISTINCT sha256 FROM current_works w JOIN media USING (work_id) JOIN cma USING (media_id) JOIN assets USING (asset_id) WHERE w.rating = 'O'",
    "q_works_any": f"{_WORKS} SELECT DISTINCT sha256 FROM works w JOIN media USING (work_id) JOIN held USING (media_id) JOIN assets USING (asset_id) WHERE w.kind = '1-URGENT'",
    "q_first_page": f"{_WORKS} SELECT sha256, work_id, ordinal FROM media JOIN cma USING (media_id) JOIN assets USING (asset_id) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY work_id, ordinal) = 1",
    "q_object_works": f"{_WORKS} SELECT sha256, count(DISTINCT work_id) AS works, count(DISTINCT author_id) AS authors, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM media JOIN cma USING (media_id) JOIN assets USING (asset_id) JOIN works USING (work_id) GROUP BY 1",
    "q_author_pages": f"{_WORKS}, f AS (SELECT author_id, work_id, row_number() OVER (PARTITION BY author_id ORDER BY created DESC, work_id) AS place FROM works QUALIFY place <= 2), p AS (SELECT * FROM media QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ordinal, media_id) <= 2) SELECT author_id, place, work_id, ordinal, media_id FROM f JOIN p USING (work_id)",
    "q_latest_records": f"{_RECENT} SELECT ordinal, post_key, row_id, coarse = 1 AS coarse FROM l",
    "q_metadata_winners": f"""{_RECENT}, n AS (SELECT ordinal, row_id AS newest FROM l QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY {_ORDER}) = 1),
      g AS (SELECT ordinal, row_id AS legacy FROM l QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY CASE WHEN rating IN ('g', 's') THEN 1 ELSE 0 END DESC, {_ORDER}) = 1) SELECT ordinal, newest, legacy FROM n JOIN g USING (ordinal)""",
    "q_origin_width": f"""{LAKE_SQL}, f AS (SELECT sha256, row_id FROM assets WHERE sha256 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY asset_id) = 1), w AS (SELECT sha256, CASE WHEN f.row_id % 7 > 0 THEN width END AS width FROM f LEFT JOIN observations USING (row_id))
      SELECT sha256, CASE WHEN width IS NULL THEN 'missing' ELSE 'available' END AS status, width FROM w""",
    "q_stored_dimensions": """WITH x AS (SELECT event_type, CASE WHEN value >= 50 THEN floor(value)::BIGINT END AS a, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS b FROM events), y AS (SELECT event_type, CASE WHEN a > 0 AND a <= 4294967295 THEN a END AS a, CASE WHEN b > 0 AND b <= 4294967295 THEN b END AS b FROM x)
      SELECT event_type, CASE WHEN a IS NOT NULL THEN 'details' WHEN b IS NOT NULL THEN 'raw' ELSE 'not recorded' END AS basis, count(*) AS n, sum(coalesce(a, b))::BIGINT AS total FROM y GROUP BY ALL""",
    "q_pin_overview": """WITH x AS (SELECT image_signature, pin_id, scan_id, board_id FROM pinterest_stream_pins WHERE image_signature IS NOT NULL)
      SELECT image_signature, count(DISTINCT pin_id) AS pins, count(DISTINCT scan_id) AS scans, count(DISTINCT board_id) AS boards, array_to_string(list_sort(list_distinct(list(pin_id) FILTER (pin_id IS NOT NULL)))[1:3], ',') AS first_pins FROM x GROUP BY 1""",
    "q_project_objects": """WITH r AS (SELECT 'supplier' AS kind, s_suppkey::BIGINT AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part)
      SELECT * FROM r WHERE contains(lower(name), 'r') AND (name, kind, id) > ('Customer#000000005', 'customer', 0) ORDER BY name, kind, id LIMIT 61""",
    "q_references": """WITH l AS (SELECT l_partkey AS part, 'supplier' AS type, l_suppkey AS target FROM lineitem UNION SELECT l_partkey, 'order', l_orderkey FROM lineitem UNION SELECT l_partkey, 'customer', o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
      SELECT part, type, count(*) AS n, min(target) AS first FROM l GROUP BY ALL""",
    "q_candidates": """WITH o AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice / 1000)::BIGINT AS exposure FROM orders) SELECT * FROM o WHERE o_orderstatus IN ('F', 'O') AND exposure >= 20 AND (exposure, o_orderkey) > (40, 0) ORDER BY exposure, o_orderkey LIMIT 101""",
    "q_cache_inventory": """WITH h AS (SELECT event_type AS family, user_id AS member, sum(strlen(props)) AS size FROM events GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY member) AS holders FROM h)
      SELECT family, count(*) AS members, count(*) FILTER (holders > 1) AS shared, round(sum(size / holders), 4) AS bytes FROM y GROUP BY 1""",
    "q_flag_histogram": "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN month(o_orderdate) = 12 THEN 'december' END]) AS flag FROM orders) WHERE flag IS NOT NULL GROUP BY 1",
    "q_consensus": "SELECT o_custkey AS author_id, CASE WHEN count(DISTINCT k) = 0 THEN 'unknown' WHEN count(DISTINCT k) > 1 THEN 'conflict' ELSE min(k) END AS rating, min(year(o_orderdate)) AS first_year FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS k FROM orders) GROUP BY 1",
    "q_batch_states": "SELECT year(l_shipdate) AS round, l_linestatus AS state, count(DISTINCT l_orderkey) AS batches, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS used FROM lineitem GROUP BY ALL",
    "q_retries": "SELECT job_id, post_id, min(retry_at) AS retry_at FROM items WHERE retry_at IS NOT NULL AND attempts < 8 AND job_id IS NOT NULL AND post_id IS NOT NULL GROUP BY ALL ORDER BY retry_at, job_id, post_id LIMIT 200",
    "q_row_range": f"{LAKE_SQL} SELECT asset_id, sha256 FROM assets JOIN observations USING (row_id) WHERE asset_id > 100 AND asset_id <= 100 + 32768 AND rating = 'g' AND score >= 30",
    "q_known_tags": f"""{LAKE_SQL}, hit AS (SELECT * FROM observations WHERE {_HAS.format("single_subject")}) SELECT DISTINCT sha256 FROM assets a WHERE sha256 IS NOT NULL AND (a.row_id IN (SELECT row_id FROM hit) OR a.post_id IN (SELECT post_id FROM hit WHERE post_id IS NOT NULL))""",
    "q_snapshot_filter": """WITH r AS (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS lo, count(*) OVER (PARTITION BY p_brand, p_size) AS k, greatest(1, ceil(count(*) OVER (PARTITION BY p_brand) * 0.2)) AS most FROM part)
      SELECT p_partkey, lo, lo + k - 1 AS hi FROM r WHERE (p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#31') AND lo <= most AND p_partkey % 5 > 0) OR p_partkey % 17 = 0""",
}
