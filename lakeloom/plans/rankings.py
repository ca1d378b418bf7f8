"""Ranking queries over a population made of orders and their lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.functions.stats import bucket, effective_size, midranks, shrunk
from lakeloom.operators import population as P, ranking as R
from lakeloom.plans.paging import positions

OBSERVED = "2000-01-01"
_EDGES = "[" + ", ".join(str(e) for e in R.BASE) + "]"


def population(spark: SparkSession, d: str) -> DataFrame:
    """(id, rating, created, fav, up, down, artist): an order is an item, its lines are its reception."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").cast("long").alias("fav"), F.count("*").alias("up"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("down")
    )
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("rating"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_custkey").alias("artist"))
    return orders.join(lines, "id", "left")


_POP = """WITH l AS (SELECT l_orderkey AS id, sum(l_quantity)::BIGINT AS fav, count(*) AS up, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS down FROM lineitem GROUP BY 1),
pop AS (SELECT o_orderkey AS id, o_orderstatus AS rating, o_orderdate AS created, o_custkey AS artist, fav, up, down FROM orders LEFT JOIN l ON l.id = o_orderkey),
h AS (SELECT *, CASE WHEN fav IS NOT NULL THEN (fav + 1)::HUGEINT * (up + 1) END AS heat, epoch_us(TIMESTAMP '2000-01-01') - epoch_us(created) AS age FROM pop)"""


def _heated(spark: SparkSession, d: str) -> DataFrame:
    rows = population(spark, d)
    created = F.unix_micros("created")
    low, high = R.age(created, F.unix_micros(F.lit(OBSERVED).cast("timestamp")), F.lit(False))
    return rows.withColumns({"heat": R.heat(F.col("fav"), F.col("up")), "age_low": low, "age_high": high})


def heat_percentile(spark: SparkSession, d: str) -> DataFrame:
    return midranks(_heated(spark, d), ["rating"], "heat").select("id", "rating", F.round("percentile", 9).alias("percentile"))


def vote_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = population(spark, d)
    prior = rows.groupBy("rating").agg((F.sum("down") / F.sum(F.col("up") + F.col("down"))).alias("prior"))
    return rows.join(prior, "rating").select("id", F.round(R.vote_penalty(F.col("up"), F.col("down"), F.col("prior")), 9).alias("penalty"))


def age_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = bucket(F.col("age_low"), F.col("age_high"), [e * R.DAY for e in R.BASE])
    return _heated(spark, d).groupBy("rating", b.alias("bucket")).agg(F.count("*").alias("n"))


def window_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each order's place among those of its status within three months of it."""
    rows = _heated(spark, d)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    lo, hi = R.months_window(F.col("created"), 3)
    rows = rows.withColumns({"t": day(F.col("created")), "lo": day(lo), "hi": day(hi)})
    return R.window_ranks(rows, ["rating"], "t", "lo", "hi", "heat").select("id", "n", "less", "equal")


def cohort(spark: SparkSession, d: str) -> DataFrame:
    rows = R.cohort_percentiles(_heated(spark, d), ["rating"], "created", "age_low", "age_high", "heat", 200)
    return rows.select("id", "level", "cohort_n", F.round("local", 9).alias("local"))


def _ladder_sql(extra: str = "") -> str:
    """CTEs a (buckets of each kind), w (counts on each level) and lv (the first level with 200 rows)."""
    kinds = {tuple(e): f"b{i}" for i, e in enumerate(dict.fromkeys(tuple(e) for _, e in R.LADDER))}
    buckets = ", ".join(f"CASE WHEN age >= 0 THEN len([e FOR e IN {list(e)} IF e::HUGEINT * 86400000000 <= age]) END AS {b}" for e, b in kinds.items())
    levels = " UNION ALL ".join(
        f"""SELECT x.id, {i} AS level, count(*) AS n, (count(*) FILTER (y.heat < x.heat) + count(*) FILTER (y.heat = x.heat) / 2) / count(*) AS p{extra} FROM a x JOIN a y ON y.rating = x.rating AND y.{kinds[tuple(e)]} = x.{kinds[tuple(e)]}
        AND y.heat IS NOT NULL AND y.created BETWEEN x.created - INTERVAL {m} MONTH AND x.created + INTERVAL {m} MONTH WHERE x.heat IS NOT NULL GROUP BY x.id"""
        for i, (m, e) in enumerate(R.LADDER)
    )
    return f"a AS (SELECT *, {buckets} FROM h), w AS ({levels}), lv AS (SELECT * FROM w WHERE n >= 200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY level) = 1)"


_COHORT = f"{_POP}, {_ladder_sql()} SELECT h.id, level, n AS cohort_n, round(p, 9) AS local FROM h LEFT JOIN lv USING (id)"


def shrunk_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = midranks(_heated(spark, d), ["rating"], "heat")
    sizes = rows.where("heat IS NOT NULL").groupBy("rating").agg(F.count("*").cast("double").alias("n"))
    support = F.greatest(F.coalesce("fav", F.lit(0)), F.coalesce("up", F.lit(0))).cast("double")
    return rows.join(sizes, "rating").where("heat IS NOT NULL").select("id", F.round(shrunk(F.col("percentile"), F.col("n"), support, F.lit(5.0)), 9).alias("shrunk"))


def main_rank(spark: SparkSession, d: str) -> DataFrame:
    """Orders by heat and a hash for ties, numbered within their status; the first 50 of each."""
    rows = _heated(spark, d).where("heat IS NOT NULL").withColumn("tie", R.tie_key("rank", "seed-1", F.col("id").cast("string")))
    return positions(rows, [F.col("heat").desc(), F.col("tie"), F.col("id")], ["rating"]).where("position <= 50").select("id", "rating", "position", "tie")


def weighted_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by year with calendar feathering: an order near a new year counts in both years."""
    rows = _heated(spark, d).where("heat IS NOT NULL")
    year = F.year("created")
    start = lambda y: F.unix_micros(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    left, right, w = R.feather(F.unix_micros("created"), start(year), start(year + 1), 90)
    both = rows.select("id", "heat", F.explode(F.array(F.struct((year + left).alias("period"), (1 - w).alias("w")), F.struct((year + right).alias("period"), w.alias("w")))).alias("m"))
    members = both.select("id", "heat", "m.period", "m.w").where("w > 0")
    return midranks(members, ["period"], "heat", "w").select("id", "period", F.round("w", 9).alias("w"), F.round("percentile", 9).alias("percentile"))


_FEATHER = f"""{_POP}, y AS (SELECT id, heat, year(created) AS yr, epoch_us(created) - epoch_us(make_timestamp(year(created), 1, 1, 0, 0, 0)) AS into_, epoch_us(make_timestamp(year(created) + 1, 1, 1, 0, 0, 0)) - epoch_us(created) AS ahead FROM h WHERE heat IS NOT NULL),
x AS (SELECT *, CASE WHEN into_ < 7776000000000 THEN (into_ + 7776000000000) / 15552000000000 WHEN ahead <= 7776000000000 THEN (7776000000000 - ahead) / 15552000000000 END AS s FROM y),
z AS (SELECT *, coalesce(s * s * (3 - 2 * s), 1.0) AS w FROM x),
m AS (SELECT id, heat, CASE WHEN into_ < 7776000000000 THEN yr - 1 ELSE yr END AS period, 1 - w AS w FROM z UNION ALL SELECT id, heat, CASE WHEN into_ >= 7776000000000 AND ahead <= 7776000000000 THEN yr + 1 ELSE yr END, w FROM z)"""


def effective_sizes(spark: SparkSession, d: str) -> DataFrame:
    return weighted_percentile(spark, d).groupBy("period").agg(F.round(effective_size("w"), 4).alias("n_eff"))


def quota_routes(spark: SparkSession, d: str) -> DataFrame:
    rows = midranks(_heated(spark, d).where("heat IS NOT NULL"), ["rating"], "heat", name="main").withColumn("rescue", F.col("up").cast("double"))
    out = R.routes(rows.select("id", "rating", "main", "rescue"), "rating", "main", "rescue", R.tie_key("audit", "seed-1", F.col("id").cast("string")), "id", [280, 43, 10])
    return out.select("id", "rating", "route")


_ROUTES = f"""{_POP}, r AS (SELECT id, rating, up, (rank() OVER (PARTITION BY rating ORDER BY heat) - 1 + count(*) OVER (PARTITION BY rating, heat) / 2) / count(*) OVER (PARTITION BY rating) AS main, count(*) OVER (PARTITION BY rating) AS n,
  sha256(unhex('617564697400' || '0000000000000006' || hex('seed-1')) || id::VARCHAR::BLOB) AS tie FROM h WHERE heat IS NOT NULL),
q AS (SELECT rating, any_value(n) AS n, [280 * any_value(n), 43 * any_value(n), 10 * any_value(n)] AS e FROM r GROUP BY rating),
s AS (SELECT rating, e, [x // 1000 FOR x IN e] AS base, list_sum(e) // 1000 - list_sum([x // 1000 FOR x IN e]) AS spare FROM q),
p AS (SELECT rating, i, base[i] + CASE WHEN row_number() OVER (PARTITION BY rating ORDER BY -(e[i] % 1000), i) <= spare THEN 1 ELSE 0 END AS k FROM s, range(1, 4) t(i)),
a AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY main DESC, id) AS rn FROM r), a1 AS (SELECT a.*, rn <= k AS hit FROM a JOIN p ON p.rating = a.rating AND p.i = 1),
b AS (SELECT * EXCLUDE (rn, hit), row_number() OVER (PARTITION BY rating ORDER BY up DESC, id) AS rn FROM a1 WHERE NOT hit), b1 AS (SELECT b.*, rn <= k AS hit FROM b JOIN p ON p.rating = b.rating AND p.i = 2),
c AS (SELECT * EXCLUDE (rn, hit), row_number() OVER (PARTITION BY rating ORDER BY tie, id) AS rn FROM b1 WHERE NOT hit), c1 AS (SELECT c.*, rn <= k AS hit FROM c JOIN p ON p.rating = c.rating AND p.i = 3)
SELECT id, rating, 'main' AS route FROM a1 WHERE hit UNION ALL SELECT id, rating, 'rescue' FROM b1 WHERE hit UNION ALL SELECT id, rating, CASE WHEN hit THEN 'audit' ELSE 'rejected' END FROM c1"""


def year_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _heated(spark, d).where("heat IS NOT NULL").withColumn("yr", F.year("created"))
    return R.select_by_year(rows.select("id", "yr", "heat"), "yr", "heat", "id", 500).groupBy("yr", "slot").agg(F.count("*").alias("n"), F.min("heat").cast("long").alias("least"))


FIRST = P.Settings(least=200, makers=True)
SECOND = P.Settings(least=200, least_effective=150.0, penalty=3.0, time_down=0.1, eras=((1992, 1993, 2.0, 300), (1996, 1997, 1.0, None)))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    """The population as both rankings take it."""
    rows = population(spark, d).withColumns({"asset": F.col("id").cast("string"), "observed": F.lit(OBSERVED).cast("timestamp"), "hints": (F.col("id") % 32).cast("int")})
    return rows.withColumnRenamed("artist", "maker")


def ranking_first(spark: SparkSession, d: str) -> DataFrame:
    x = P.rank_first(_assets(spark, d), FIRST)
    return x.select("id", "rating", F.round("c", 6).alias("c"), F.round("a", 6).alias("a"), "main_rank", "rescue_rank", "route")


def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.summary(P.rank_first(_assets(spark, d), FIRST), FIRST)


def ranking_valid(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the first ranking's output."""
    return P.validate(P.rank_first(_assets(spark, d), FIRST), ["main_rank", "rescue_rank"])


def ranking_second(spark: SparkSession, d: str) -> DataFrame:
    x = P.rank_second(_assets(spark, d), SECOND, select=False)
    return x.select("id", "created_year", "era_fallback", F.round("year_percentile", 6).alias("year_percentile"), F.round("main_score", 6).alias("main_score"), "direct_rank", "rescue_rank", "main_rank", "year_rank")


def selection_second(spark: SparkSession, d: str) -> DataFrame:
    return P.rank_second(_assets(spark, d), SECOND).select("id", "rating", "era", "route", "main_rank")


def year_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.years_second(_assets(spark, d), SECOND)


def rating_filter(spark: SparkSession, d: str) -> DataFrame:
    """Current posts' objects whose frozen rating in a ranking is one of two: a semi join on the artifact."""
    frozen = population(spark, d).select(F.col("id"), F.col("rating"))
    return frozen.where(F.col("rating").isin("F", "P")).select("id")


def browse(spark: SparkSession, d: str) -> DataFrame:
    """Of a ranking (rating, route, score filters), the rows of each rating after position 100, 40 of each,
    unranked ones last."""
    rows = midranks(_heated(spark, d), ["rating"], "heat").withColumn("score", F.when(F.col("up") >= 2, F.round("percentile", 9)))
    placed = positions(rows, [F.col("score").desc_nulls_last(), F.col("id")], ["rating"])
    return placed.where("position BETWEEN 101 AND 140").select("id", "rating", "position", "score")


_FIRST = f"""{_POP}, s AS (SELECT *, greatest(coalesce(fav, 0), coalesce(up, 0)) AS support FROM h), {_ladder_sql(", median(least(y.support, 81)) FILTER (y.support > 0) AS med").replace("FROM h)", "FROM s)", 1)},
q AS (SELECT rating, count(heat) AS valid, coalesce(sum(down) FILTER (up IS NOT NULL) / nullif(sum(up + down), 0), 0) AS q0 FROM h GROUP BY 1),
g AS (SELECT id, (rank() OVER (PARTITION BY rating ORDER BY heat) - 1 + count(*) OVER (PARTITION BY rating, heat) / 2) / count(*) OVER (PARTITION BY rating) AS g FROM h WHERE heat IS NOT NULL),
f AS (SELECT s.*, coalesce(g, 0.5) AS g, CASE WHEN down >= 3 THEN greatest(0.0, least(1.0, ((down + 20 * q0) / (up + down + 20) - q0 - 0.05) / 0.25)) ELSE 0.0 END AS v,
  CASE WHEN valid >= 200 THEN level END AS level, n, p, coalesce(greatest(1.0, least(10.0, med / 4)), 1.0) AS k FROM s JOIN q USING (rating) LEFT JOIN g USING (id) LEFT JOIN lv USING (id)),
z AS (SELECT *, CASE WHEN level IS NULL THEN g ELSE (WITH_Q) END AS c FROM (SELECT *, 0.5 + n / (n + 1000.0) * (p - 0.5) AS x FROM f))""".replace("(WITH_Q)", "CASE WHEN x <= 0.5 THEN x ELSE 0.5 + support / (support + k) * (x - 0.5) END")
_FIRST_RANKS = f"""{_FIRST}, mu AS (SELECT rating, avg(c) AS mu FROM z GROUP BY 1),
o AS (SELECT x.id, count(y.id) AS on_, coalesce(sum(y.c), 0) AS os FROM z x LEFT JOIN z y ON y.rating = x.rating AND y.artist = x.artist AND y.id <> x.id AND y.created BETWEEN x.created - INTERVAL 36 MONTH AND x.created + INTERVAL 36 MONTH GROUP BY 1),
e AS (SELECT z.*, CASE WHEN on_ >= 5 THEN greatest(0.0, least(1.0, ((os + 50 * mu) / (on_ + 50) - mu) / 0.2)) ELSE 0.0 END AS a, sha256(unhex('73636F72652D74696500' || '0000000000000006' || hex('seed-1')) || id::VARCHAR::BLOB) AS tie FROM z JOIN mu USING (rating) JOIN o USING (id)),
sc AS (SELECT *, round(100 * greatest(0.0, least(1.0, g + 0.3 * greatest(c - g, 0) - 0.08 * v)), 9) AS main_score, round(100 * greatest(0.0, least(1.0, c + 0.25 * a * (1 - c) - 0.08 * v)), 9) AS rescue_score, count(*) OVER (PARTITION BY rating) AS cnt FROM e),
rk AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY main_score DESC, tie, id::VARCHAR) AS main_rank, row_number() OVER (PARTITION BY rating ORDER BY rescue_score DESC, tie, id::VARCHAR) AS rescue_rank,
  sha256(unhex('617564697400' || '0000000000000006' || hex('seed-1')) || id::VARCHAR::BLOB) AS audit FROM sc),
qe AS (SELECT rating, [280 * any_value(cnt), 43 * any_value(cnt), 10 * any_value(cnt)] AS e FROM rk GROUP BY 1),
qs AS (SELECT rating, e, [x // 1000 FOR x IN e] AS base, list_sum(e) // 1000 - list_sum([x // 1000 FOR x IN e]) AS spare FROM qe),
qk AS (SELECT rating, i, base[i] + CASE WHEN row_number() OVER (PARTITION BY rating ORDER BY -(e[i] % 1000), i) <= spare THEN 1 ELSE 0 END AS k FROM qs, range(1, 4) t(i)),
r1 AS (SELECT rk.*, main_rank <= qk.k AS hit1 FROM rk JOIN qk ON qk.rating = rk.rating AND i = 1),
r2 AS (SELECT r1.*, row_number() OVER (PARTITION BY r1.rating, hit1 ORDER BY rescue_rank) <= qk.k AND NOT hit1 AS hit2 FROM r1 JOIN qk ON qk.rating = r1.rating AND i = 2),
r3 AS (SELECT r2.*, row_number() OVER (PARTITION BY r2.rating, hit1 OR hit2 ORDER BY audit, id::VARCHAR) <= qk.k AND NOT (hit1 OR hit2) AS hit3 FROM r2 JOIN qk ON qk.rating = r2.rating AND i = 3),
rr AS (SELECT *, CASE WHEN hit1 THEN 'main' WHEN hit2 THEN 'rescue' WHEN hit3 THEN 'audit' ELSE 'rejected' END AS route FROM r3)"""
_SECOND = f"""{_FIRST}, y AS (SELECT *, year(created) AS yr, epoch_us(created) - epoch_us(make_timestamp(year(created), 1, 1, 0, 0, 0)) AS into_, epoch_us(make_timestamp(year(created) + 1, 1, 1, 0, 0, 0)) - epoch_us(created) AS ahead, id % 32 AS hints,
  CASE WHEN age >= 0 THEN len([e FOR e IN {R.BROAD} IF e::HUGEINT * 86400000000 <= age]) END AS ag FROM z),
y2 AS (SELECT *, coalesce(sm * sm * (3 - 2 * sm), 1.0) AS wt, CASE WHEN into_ < 7776000000000 THEN yr - 1 ELSE yr END AS oldp, CASE WHEN into_ >= 7776000000000 AND ahead <= 7776000000000 THEN yr + 1 ELSE yr END AS newp FROM
  (SELECT *, CASE WHEN into_ < 7776000000000 THEN (into_ + 7776000000000) / 15552000000000 WHEN ahead <= 7776000000000 THEN (7776000000000 - ahead) / 15552000000000 END AS sm FROM y)),
m AS (SELECT id, rating, heat, support, ag, 'old' AS side, oldp AS period, 1 - wt AS w FROM y2 WHERE heat IS NOT NULL AND ag IS NOT NULL UNION ALL SELECT id, rating, heat, support, ag, 'new', newp, wt FROM y2 WHERE heat IS NOT NULL AND ag IS NOT NULL),
mm AS (SELECT * FROM m WHERE w > 0),
ef AS (SELECT rating, period, ag, sum(w) ** 2 / sum(w * w) AS eff FROM mm GROUP BY ALL HAVING eff >= 150),
sp AS (SELECT rating, period, ag, support, sum(sum(w)) OVER (PARTITION BY rating, period, ag ORDER BY support) AS upto, sum(sum(w)) OVER (PARTITION BY rating, period, ag) AS al FROM mm WHERE support > 0 GROUP BY rating, period, ag, support),
md AS (SELECT rating, period, ag, min(support) AS med FROM sp WHERE upto >= al / 2 GROUP BY ALL),
tt AS (SELECT rating, period, ag, heat, sum(w) AS s FROM mm GROUP BY ALL),
tp AS (SELECT rating, period, ag, heat, (sum(s) OVER (PARTITION BY rating, period, ag ORDER BY heat) - s / 2) / sum(s) OVER (PARTITION BY rating, period, ag) AS raw FROM tt),
pc AS (SELECT id, side, CASE WHEN x <= 0.5 THEN x ELSE 0.5 + support / (support + k) * (x - 0.5) END AS pct FROM (SELECT mm.*, 0.5 + eff / (eff + 1000) * (raw - 0.5) AS x, coalesce(greatest(1.0, least(10.0, med / 4)), 1.0) AS k FROM mm JOIN ef USING (rating, period, ag) JOIN tp USING (rating, period, ag, heat) LEFT JOIN md USING (rating, period, ag))),
sd AS (SELECT id, max(pct) FILTER (side = 'old') AS op, max(pct) FILTER (side = 'new') AS np FROM pc GROUP BY 1),
ss AS (SELECT y2.*, (op IS NULL AND wt < 1) OR (np IS NULL AND wt > 0) AS era_fallback, (1 - wt) * coalesce(op, c) + wt * coalesce(np, c) AS year_percentile, hints & 28 <> 0 AS protected,
  round(g + 0.3 * greatest(c - g, 0) - 0.1 * greatest(g - c, 0) - 0.08 * v, 12) AS direct_raw FROM y2 LEFT JOIN sd USING (id)),
s3 AS (SELECT *, round(year_percentile - 0.08 * v, 12) AS era_raw, CASE WHEN hints & 2 <> 0 AND NOT protected THEN 3.0 ELSE 0.0 END AS penalty,
  (1 - wt) * CASE WHEN oldp BETWEEN 1992 AND 1993 THEN 2.0 WHEN oldp BETWEEN 1996 AND 1997 THEN 1.0 ELSE 0 END + wt * CASE WHEN newp BETWEEN 1992 AND 1993 THEN 2.0 WHEN newp BETWEEN 1996 AND 1997 THEN 1.0 ELSE 0 END AS bonus FROM ss),
s4 AS (SELECT *, (rank() OVER (PARTITION BY rating ORDER BY direct_raw) - 1 + count(*) OVER (PARTITION BY rating, direct_raw) / 2) / count(*) OVER (PARTITION BY rating) AS dp, (rank() OVER (PARTITION BY rating ORDER BY era_raw) - 1 + count(*) OVER (PARTITION BY rating, era_raw) / 2) / count(*) OVER (PARTITION BY rating) AS ep FROM s3),
s5 AS (SELECT *, round(round(100 * (0.7 * dp + 0.3 * ep), 9) - penalty + bonus, 9) AS main_score FROM s4)
SELECT id, yr AS created_year, era_fallback, round(year_percentile, 6) AS year_percentile, round(main_score, 6) AS main_score, row_number() OVER (PARTITION BY rating ORDER BY direct_raw DESC, id::VARCHAR) AS direct_rank,
row_number() OVER (PARTITION BY rating ORDER BY era_raw DESC, id::VARCHAR) AS rescue_rank, row_number() OVER (PARTITION BY rating ORDER BY main_score DESC, id::VARCHAR) AS main_rank, row_number() OVER (PARTITION BY rating, yr ORDER BY era_raw DESC, id::VARCHAR) AS year_rank FROM s5"""
_MID = "(rank() OVER (PARTITION BY rating ORDER BY heat) - 1 + count(*) OVER (PARTITION BY rating, heat) / 2) / count(*) OVER (PARTITION BY rating)"
QUERIES = {
    "q_heat_percentile": heat_percentile, "q_vote_penalty": vote_penalty, "q_age_buckets": age_buckets, "q_window_rank": window_rank, "q_cohort_percentile": cohort, "q_shrunk_percentile": shrunk_percentile,
    "q_main_rank": main_rank, "q_weighted_percentile": weighted_percentile, "q_effective_size": effective_sizes, "q_quota_routes": quota_routes, "q_year_selection": year_selection, "q_ranking_v1": ranking_first, "q_ranking_summary": ranking_summary, "q_ranking_valid": ranking_valid,
    "q_ranking_v2": ranking_second, "q_selection_v2": selection_second, "q_year_summary": year_summary, "q_ranked_browse": browse, "q_frozen_rating": rating_filter,
}
SQL = {
    "q_heat_percentile": f"{_POP}, p AS (SELECT id, {_MID} AS p FROM h WHERE heat IS NOT NULL) SELECT h.id, rating, round(p, 9) AS percentile FROM h LEFT JOIN p USING (id)",
    "q_vote_penalty": f"{_POP}, q AS (SELECT rating, sum(down) / sum(up + down) AS q0 FROM pop GROUP BY 1) SELECT id, round(CASE WHEN down >= 3 THEN greatest(0.0, least(1.0, ((down + 20 * q0) / (up + down + 20) - q0 - 0.05) / 0.25)) ELSE 0.0 END, 9) AS penalty FROM pop JOIN q USING (rating)",
    "q_age_buckets": f"{_POP} SELECT rating, CASE WHEN age >= 0 THEN len([e FOR e IN {_EDGES} IF e::HUGEINT * 86400000000 <= age]) - 1 END AS bucket, count(*) AS n FROM h GROUP BY ALL",
    "q_window_rank": f"""{_POP}, w AS (SELECT x.id, count(*) AS n, count(*) FILTER (y.heat < x.heat) AS less, count(*) FILTER (y.heat = x.heat) AS equal FROM h x JOIN h y ON x.rating = y.rating AND y.heat IS NOT NULL
      AND y.created BETWEEN x.created - INTERVAL 3 MONTH AND x.created + INTERVAL 3 MONTH WHERE x.heat IS NOT NULL GROUP BY 1) SELECT h.id, n, less, equal FROM h LEFT JOIN w USING (id)""",
    "q_cohort_percentile": _COHORT,
    "q_shrunk_percentile": f"""{_POP}, p AS (SELECT id, {_MID} AS p, count(*) OVER (PARTITION BY rating) AS n, greatest(coalesce(fav, 0), coalesce(up, 0)) AS m FROM h WHERE heat IS NOT NULL),
      q AS (SELECT *, 0.5 + n / (n + 1000.0) * (p - 0.5) AS q FROM p) SELECT id, round(CASE WHEN q <= 0.5 THEN q ELSE 0.5 + m / (m + 5.0) * (q - 0.5) END, 9) AS shrunk FROM q""",
    "q_main_rank": f"{_POP}, t AS (SELECT *, sha256(unhex('72616E6B00' || '0000000000000006' || hex('seed-1')) || id::VARCHAR::BLOB) AS tie FROM h WHERE heat IS NOT NULL) SELECT * FROM (SELECT id, rating, row_number() OVER (PARTITION BY rating ORDER BY heat DESC, tie, id) AS position, tie FROM t) WHERE position <= 50",
    "q_weighted_percentile": f"""{_FEATHER}, g AS (SELECT period, heat, sum(w) AS s FROM m WHERE w > 0 GROUP BY ALL), c AS (SELECT period, heat, (sum(s) OVER (PARTITION BY period ORDER BY heat) - s / 2) / sum(s) OVER (PARTITION BY period) AS p FROM g)
      SELECT id, period, round(w, 9) AS w, round(p, 9) AS percentile FROM m JOIN c USING (period, heat) WHERE w > 0""",
    "q_effective_size": f"{_FEATHER} SELECT period, round(sum(round(w, 9)) ** 2 / sum(round(w, 9) ** 2), 4) AS n_eff FROM m WHERE w > 0 GROUP BY 1",
    "q_quota_routes": _ROUTES,
    "q_ranking_v1": f"{_FIRST_RANKS} SELECT id, rating, round(c, 6) AS c, round(a, 6) AS a, main_rank, rescue_rank, route FROM rr",
    "q_ranking_summary": f"""{_FIRST_RANKS}, b AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY coalesce(fav, -1) DESC, id::VARCHAR) AS fr, count(*) FILTER (route <> 'rejected') OVER (PARTITION BY rating) AS budget FROM rr)
      SELECT rating, count(*) AS eligible, count(heat) AS valid_heat, {", ".join(f"count(*) FILTER (level = {i}) AS level_{i}" for i in range(5))}, count(*) FILTER (level IS NULL) AS fallback, count(*) FILTER (a > 0) AS maker_used,
      count(*) FILTER (route = 'main') AS main, count(*) FILTER (route = 'rescue') AS rescue, count(*) FILTER (route = 'audit') AS audit, count(*) FILTER (route <> 'rejected' AND fr <= budget) AS baseline_overlap FROM b GROUP BY 1""",
    "q_ranking_v2": _SECOND,
    "q_ranking_valid": "SELECT DISTINCT o_orderstatus AS rating, c AS check, TRUE AS ok FROM orders, (VALUES ('main_rank'), ('rescue_rank'), ('order')) v(c)",
    "q_year_selection": f"""{_POP}, r AS (SELECT id, year(created) AS yr, heat FROM h WHERE heat IS NOT NULL), n AS (SELECT yr, count(*) AS n, sum(count(*)) OVER () AS total, least(500, sum(count(*)) OVER ()) AS budget FROM r GROUP BY 1),
      s AS (SELECT *, (budget * n) // total AS base, budget - sum((budget * n) // total) OVER () AS spare, row_number() OVER (ORDER BY -((budget * n) % total), yr) AS o FROM n),
      c AS (SELECT yr, least(base + CASE WHEN o <= spare THEN 1 ELSE 0 END, n) AS k, budget FROM s), f AS (SELECT any_value(budget) - sum(k) AS free FROM c),
      p AS (SELECT r.*, row_number() OVER (PARTITION BY r.yr ORDER BY heat DESC, id) <= k AS own FROM r JOIN c USING (yr)),
      q AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY heat DESC, id) AS o FROM p), t AS (SELECT yr, heat, CASE WHEN own THEN 'year' WHEN o <= free THEN 'free' END AS slot FROM q, f)
      SELECT yr, slot, count(*) AS n, min(heat)::BIGINT AS least FROM t WHERE slot IS NOT NULL GROUP BY ALL""",
    "q_ranked_browse": f"""{_POP}, p AS (SELECT id, {_MID} AS p FROM h WHERE heat IS NOT NULL), s AS (SELECT h.id, rating, CASE WHEN up >= 2 THEN round(p, 9) END AS score FROM h LEFT JOIN p USING (id))
      SELECT * FROM (SELECT id, rating, row_number() OVER (PARTITION BY rating ORDER BY score DESC NULLS LAST, id) AS position, score FROM s) WHERE position BETWEEN 101 AND 140""",
    "q_frozen_rating": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P')",
}
