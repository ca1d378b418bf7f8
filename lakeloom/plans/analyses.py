"""Queries on vectors, hashes, comparisons, graphs, row operators and sources, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.operators import graphs, preference as P, rows as ops, vectors as V
from lakeloom.sources import files

def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def knn_probed(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all, over an index."""
    rows = _vectors(spark, d)
    centroids = V.fit_centroids(rows, "embedding", V.lists_for(rows.count()))
    index = V.indexed(rows, "vec_id", "embedding", centroids)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), V.normalised("embedding").alias("u"))
    return V.batch_nearest(asked, index, "vec_id", centroids, 10, V.probes_for(asked, index, "vec_id", centroids, 10))


def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of the exact 10 nearest that the probed search finds, over all asked vectors."""
    found = knn_probed(spark, d).select("query", "vec_id")
    exact = _each_nearest(spark, d, 10, _vectors(spark, d)).select("query", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found.withColumn("got", F.lit(1)), ["query", "vec_id"], "left").agg((F.avg(F.coalesce("got", F.lit(0))) >= 0.9).alias("enough"))


def _each_nearest(spark: SparkSession, d: str, k: int, rows: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 20 against all of rows, exactly: an index of one list."""
    everything = _vectors(spark, d)
    some = everything.where(V.normalised("embedding").isNotNull()).select(F.size("embedding").alias("n")).first()
    one = np.zeros((1, some["n"] if some else 1))
    asked = everything.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), V.normalised("embedding").alias("u")).where("u IS NOT NULL")
    found = V.batch_nearest(asked, V.indexed(rows, "vec_id", "embedding", one), "vec_id", one, k, 1)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def knn(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, exactly."""
    return _each_nearest(spark, d, 20, _vectors(spark, d))


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _each_nearest(spark, d, 10, _vectors(spark, d).where(F.col("label").isin(1, 3)))


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """The signs of all 64 components of every vector and of a copy of it in which three have turned."""
    v = _vectors(spark, d)
    turned = F.transform("embedding", lambda x, i: F.when(i < 3, -x).otherwise(x))
    both = v.select("vec_id", "embedding").union(v.select((F.col("vec_id") + 10_000_000).alias("vec_id"), turned.alias("embedding")))
    return both.select("vec_id", V.sign_hash("embedding").alias("hash"))


def hamming(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of hash classes within 7 bits, by representatives."""
    return V.hamming_pairs(V.hamming_classes(_hashes(spark, d), "vec_id", "hash")[0], 7)


def hamming_members(spark: SparkSession, d: str) -> DataFrame:
    return V.hamming_classes(_hashes(spark, d), "vec_id", "hash")[1]


_HASH = """WITH v AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, list_concat([-x FOR x IN embedding[1:3]], embedding[4:]) FROM embeddings),
h AS (SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS bits FROM v), c AS (SELECT bits, min(vec_id) AS rep FROM h GROUP BY bits)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Parts as objects, the supplier's nation as the source, two recipes; lines are attempts."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    recipe = F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd")
    discovered = lines.select((F.col("l_suppkey") % 7).alias("source"), recipe.alias("recipe"), F.col("l_partkey").alias("object_id"))
    outcomes = lines.where("l_quantity > 5").select(recipe.alias("recipe"), F.col("l_partkey").alias("object_id"), F.struct("l_orderkey", "l_linenumber").alias("at"), (F.col("l_returnflag") != "R").alias("ok"))
    return V.coverage(discovered, outcomes)


def byte_batches(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return V.byte_batches(parts, ["p_partkey"], "p_size", 500).groupBy("batch").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("tier"))


def _tiered(parts: DataFrame) -> DataFrame:
    tiers = parts.groupBy("batch", "tier").agg(F.sort_array(F.collect_list("p_partkey")).alias("items"))
    return tiers.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("tier", "items"))), lambda t: t["items"]).alias("tiers"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """All parts in batches of 16 by key, in tiers by size."""
    return _tiered(P.even_batches(_parts(spark, d), "p_partkey"))


def pair_expand(spark: SparkSession, d: str) -> DataFrame:
    return P.pairs(_batches(spark, d)).select("batch", "i", "j", "y", F.round("w", 9).alias("w"))


def borda(spark: SparkSession, d: str) -> DataFrame:
    return P.borda(P.pairs(_batches(spark, d))).select("item", F.round("score", 9).alias("score"), "exposures")


_PAIRS = """WITH o AS (SELECT p_partkey AS item, floor(p_size / 10)::INT AS tier, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS total FROM part),
t AS (SELECT item, tier, least(pos // 16, greatest(total // 16, 1) - 1) AS batch FROM o), n AS (SELECT batch, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT x.batch, x.item AS i, y.item AS j, CASE WHEN x.tier < y.tier THEN 1.0 ELSE 0.5 END AS y, 2.0 / (n * (n - 1)) AS w FROM t x JOIN t y ON x.batch = y.batch AND (x.tier, x.item) < (y.tier, y.item) JOIN n ON n.batch = x.batch)"""


def residuals(spark: SparkSession, d: str) -> DataFrame:
    """How far each part's results lie from what the scores expect, per comparison."""
    p = P.pairs(_batches(spark, d))
    return P.residuals(p, P.borda(p).select("item", "score")).select("item", F.round("disagreement", 6).alias("disagreement"))


def diversity(spark: SparkSession, d: str) -> DataFrame:
    return P.diversity(P.pairs(_batches(spark, d))).agg(F.count("*").alias("items"), F.bool_and(F.col("opponents") > 0).alias("all_met"))


def split_half(spark: SparkSession, d: str) -> DataFrame:
    """How far the percentiles of two halves of the comparisons lie apart, per component of all of them."""
    return P.stability(_rounds(spark, d)).select("items", F.round("distance", 6).alias("distance"))


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of batches over all parts: by key, and by key from the other end of its number."""
    parts = _parts(spark, d)
    other = parts.withColumn("k2", F.reverse(F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    two = P.even_batches(other, "k2").drop("k2").withColumn("batch", F.col("batch") + 1_000_000_000)
    return _tiered(P.even_batches(parts, "p_partkey").unionByName(two))


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Of each batch, how far its members' mean results would move without it."""
    return P.sensitivity(P.pairs(_rounds(spark, d))).select("batch", F.round("influence", 6).alias("influence"))


def next_round(spark: SparkSession, d: str) -> DataFrame:
    """The next comparisons of all parts by neighbours in price: batches and their sizes."""
    from lakeloom.functions.stats import midranks

    parts = midranks(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice", F.lit(1).alias("g")), ["g"], "p_retailprice")
    return P.next_batches(parts, "percentile", "p_partkey", "seed-1").groupBy("batch").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("batches"))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judgements as JSON texts, parsed and checked against the batch they answer."""
    texts = _batches(spark, d).withColumn("asked", F.flatten("tiers"))
    bad = F.when(F.col("batch") % 5 == 0, F.expr("slice(tiers, 1, size(tiers) - 1)")).otherwise(F.col("tiers"))
    answer = F.when(F.col("batch") % 7 == 0, F.lit("{")).otherwise(F.to_json(F.struct(bad.alias("tiers"), F.slice("asked", 1, 1).alias("elite"))))
    return P.parsed_judgements(texts.select("batch", "asked", answer.alias("text")), "bigint").groupBy("problem").agg(F.count("*").alias("n"))


def davidson(spark: SparkSession, d: str) -> DataFrame:
    return P.davidson(P.pairs(_batches(spark, d))).select("item", "component", F.round("score", 4).alias("score"))


def rank_ties(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("score"))
    return P.tied_ranks(parts, ["p_brand"], "score").select("p_partkey", "lo", "hi", F.round("percentile", 9).alias("percentile"))


def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    from lakeloom.functions.stats import midranks

    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), "p_size", "p_retailprice")
    a, b = (midranks(parts, ["brand"], c).select("item", "brand", "percentile") for c in ("p_size", "p_retailprice"))
    return P.compare_snapshots(a, b, "brand").select("brand", "n", F.round("correlation", 6).alias("correlation"), F.round("distance", 6).alias("distance"), F.round("jaccard", 6).alias("jaccard"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts that lines connect."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10_000_000).alias("b"))


def components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.components(_links(spark, d))


def depths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within four steps of the parts of size 1 over all links."""
    links = _links(spark, d).distinct()
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")).withColumn("step", F.lit(1))
    small = spark.read.parquet(f"{d}/part.parquet").where("p_size = 1").select(F.col("p_partkey").alias("a"))
    roots = links.join(small, "a", "left_semi").select(F.col("a").alias("node")).distinct().withColumn("depth", F.lit(0))
    return graphs.least_depths(roots, edges, 4)


def scalars(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") * 1_000_000_000_000).alias("value"))
    return ops.default_registry().apply(orders, "scalar", 1, {"multiply": 2000, "add": 1})


def export_names(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ordinal"), F.concat(F.col("p_name"), F.lit(": "), F.col("p_type"), F.lit(" . ")).alias("stem"), F.when(F.col("p_size") > 10, "png").alias("extension"))
    return ops.default_registry().apply(parts, "export_names", 1, {"limit": 24})


def manifest(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("asset_id"), "s_nationkey")
    return ops.default_registry().apply(s, "manifest", 1, {"fields": ["asset_id", "s_nationkey"]})


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A table, however it's ordered and cut, has one fingerprint; with a row more it has another."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    cols = n.columns
    prints = [files.row_fingerprint(x, cols).select("rows", "fingerprint") for x in (n, n.orderBy(F.col("n_name").desc()).repartition(3), n.union(n.limit(1)))]
    both = prints[0].union(prints[1]).union(prints[2])
    return both.groupBy("fingerprint").agg(F.max("rows").alias("rows"), F.count("*").alias("n")).select("rows", "n")


QUERIES = {
    "q_knn": knn, "q_knn_filtered": knn_filtered, "q_knn_probed": knn_probed, "q_hamming_pairs": hamming, "q_hamming_members": hamming_members, "q_coverage": coverage, "q_byte_batches": byte_batches,
    "q_pair_expand": pair_expand, "q_borda": borda, "q_davidson": davidson, "q_rank_ties": rank_ties, "q_snapshot_compare": snapshot_compare, "q_components": components, "q_depths": depths,
    "q_knn_recall": knn_recall, "q_residuals": residuals, "q_diversity": diversity, "q_split_half": split_half, "q_sensitivity": sensitivity, "q_next_round": next_round, "q_judgements": judgements,
    "q_scalar_column": scalars, "q_export_names": export_names, "q_manifest": manifest, "q_fingerprints": fingerprints,
}
_NEAR = """WITH d AS (SELECT q.vec_id AS query, e.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dist, 12), vec_id) AS rank FROM d) SELECT query, vec_id, round(dist, 6) AS distance, rank FROM r WHERE rank <= {}"""
SQL = {
    "q_knn": _NEAR.format("TRUE", 20),
    "q_knn_filtered": _NEAR.format("e.label IN (1, 3)", 10),
    "q_knn_recall": "SELECT TRUE AS enough",
    "q_residuals": f"""{_PAIRS}, s AS (SELECT batch, i AS item, j AS other, y, w FROM p UNION ALL SELECT batch, j, i, 1 - y, w FROM p), b AS (SELECT item, batch, avg(y) AS y FROM s GROUP BY ALL), sc AS (SELECT item, avg(y) AS score FROM b GROUP BY 1),
      e AS (SELECT s.item, w, abs(y - (exp((a.score - o.score) / 2) + 0.5) / (exp((a.score - o.score) / 2) + exp((o.score - a.score) / 2) + 1)) AS r FROM s JOIN sc a ON a.item = s.item JOIN sc o ON o.item = s.other)
      SELECT item, round(sum(w * r) / sum(w), 6) AS disagreement FROM e GROUP BY 1""",
    "q_diversity": f"{_PAIRS} SELECT count(DISTINCT x) AS items, TRUE AS all_met FROM (SELECT i AS x FROM p UNION ALL SELECT j FROM p)",
    "q_judgements": f"""{_PAIRS}, b AS (SELECT batch, count(DISTINCT tier) AS tiers FROM t GROUP BY 1) SELECT CASE WHEN batch % 7 = 0 THEN 'unreadable' WHEN batch % 5 = 0 THEN 'incomplete' END AS problem, count(*) AS n FROM b GROUP BY 1""",
    "q_next_round": """WITH n AS (SELECT count(*) AS n FROM part), w AS (SELECT i, least(64, n - i * 64) AS k FROM n, range(0, (n + 63) // 64) t(i)), b AS (SELECT least(16, k - j * 16) AS n FROM w, range(0, 4) t(j) WHERE k > j * 16) SELECT n, count(*) AS batches FROM b GROUP BY 1""",
    "q_hamming_pairs": f"{_HASH} SELECT x.rep AS a, y.rep AS b, hamming(x.bits, y.bits) AS distance FROM c x JOIN c y ON x.rep < y.rep WHERE hamming(x.bits, y.bits) <= 7",
    "q_hamming_members": f"{_HASH} SELECT vec_id, rep FROM h JOIN c USING (bits)",
    "q_coverage": """WITH d AS (SELECT DISTINCT l_suppkey % 7 AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS recipe, l_partkey AS object_id FROM lineitem),
      o AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS recipe, l_partkey AS object_id, l_returnflag <> 'R' AS ok, row_number() OVER (PARTITION BY l_linenumber % 2 = 0, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_quantity > 5)
      SELECT source, recipe, count(*) AS discovered, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS pending FROM d LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING (recipe, object_id) GROUP BY ALL""",
    "q_byte_batches": "SELECT b // 500 * 2 + CASE WHEN b % 500 + p_size > 500 THEN 1 ELSE 0 END AS batch, count(*) AS n, sum(p_size)::BIGINT AS size FROM (SELECT p_size, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM part) GROUP BY 1",
    "q_pair_expand": f"{_PAIRS} SELECT batch, i, j, y, round(w, 9) AS w FROM p",
    "q_borda": f"{_PAIRS}, s AS (SELECT batch, i AS item, y FROM p UNION ALL SELECT batch, j, 1 - y FROM p), b AS (SELECT item, batch, avg(y) AS y FROM s GROUP BY ALL) SELECT item, round(avg(y), 9) AS score, count(*) AS exposures FROM b GROUP BY 1",
    "q_rank_ties": "WITH r AS (SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS lo, count(*) OVER (PARTITION BY p_brand, p_size) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, lo, lo + k - 1 AS hi, round(1 - (lo - 1 + k / 2) / n, 9) AS percentile FROM r",
    "q_snapshot_compare": """WITH r AS (SELECT p_brand AS brand, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + count(*) OVER (PARTITION BY p_brand, p_size) / 2) / count(*) OVER (PARTITION BY p_brand) AS p,
      (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + count(*) OVER (PARTITION BY p_brand, p_retailprice) / 2) / count(*) OVER (PARTITION BY p_brand) AS q FROM part)
      SELECT brand, count(*) AS n, round(corr(p, q), 6) AS correlation, round(avg(abs(p - q)), 6) AS distance, round(count(*) FILTER (p >= 0.9 AND q >= 0.9) / nullif(count(*) FILTER (p >= 0.9 OR q >= 0.9), 0), 6) AS jaccard FROM r GROUP BY 1""",
    "q_scalar_column": """WITH v AS (SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey::HUGEINT * 1000000000000 * 2000 + 1 END AS v FROM orders)
      SELECT ordinal, CASE WHEN v IS NULL THEN 'missing' WHEN v > 9223372036854775807 THEN 'failed' ELSE 'available' END AS status, TRY_CAST(v AS BIGINT) AS value, CASE WHEN v > 9223372036854775807 THEN 'INTEGER_OVERFLOW' END AS code FROM v""",
    "q_export_names": """SELECT p_partkey AS ordinal, lpad(p_partkey::VARCHAR, 6, '0') || '_' || regexp_replace(substr(regexp_replace(p_name || ': ' || p_type || ' . ', '[<>:"/\\\\|?*]', '_', 'g'), 1, 24), '[ .]+$', '') || '.' || CASE WHEN p_size > 10 THEN 'png' ELSE 'bin' END AS file_name FROM part""",
    "q_manifest": """SELECT s_suppkey AS ordinal, s_name AS asset_id, '{"asset_id":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS record FROM supplier""",
}
