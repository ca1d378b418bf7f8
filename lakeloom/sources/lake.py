"""The relations of the lake and how the given tables map to them.

objects(sha256, length, stored_ext); assets(asset_id, row_id, post_id, sha256);
observations(row_id, post_id, rating, score, width, tag_string, is_deleted, commit_seq);
current_posts(post_id, row_id, asset_id). All are derived lazily; nothing is inferred from files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

OBSERVATION = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("post_id", T.LongType()), T.StructField("rating", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("width", T.LongType()), T.StructField("tag_string", T.StringType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("commit_seq", T.LongType()),
])
ASSET = T.StructType([T.StructField("asset_id", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("post_id", T.LongType()), T.StructField("sha256", T.StringType())])
OBJECT = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("length", T.LongType()), T.StructField("stored_ext", T.StringType())])


@dataclass(frozen=True)
class Lake:
    objects: DataFrame
    assets: DataFrame
    observations: DataFrame
    current_posts: DataFrame


def newest(rows: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns (nulls least), as key + keep.

    An aggregate of structs, so that it combines before the shuffle: a hot key costs one row per
    task, which a window by row number would not."""
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in keep])


def current_posts(observations: DataFrame, assets: DataFrame) -> DataFrame:
    """(post_id, row_id, asset_id): each post's newest observation with that observation's newest asset."""
    winner = newest(observations.where("post_id IS NOT NULL"), ["post_id"], ["commit_seq", "row_id"], ["row_id"])
    own = assets.groupBy("row_id").agg(F.max("asset_id").alias("asset_id"))
    return winner.join(own, "row_id").select("post_id", "row_id", "asset_id")


def from_members(spark: SparkSession, d: str) -> Lake:
    """The lake of the members table: each row is an observation and an asset of its object."""
    m = spark.read.parquet(f"{d}/members.parquet").select("row_id", "sha", "post_id", "tags").where("row_id IS NOT NULL").distinct()
    r = F.col("row_id")
    observations = m.select(
        r, "post_id", F.when(r % 5 < 4, F.element_at(F.array(*map(F.lit, "gsqe")), (r % 5 + 1).cast("int"))).alias("rating"), F.when(r % 17 != 0, r % 101).alias("score"),
        (100 + r % 3000).alias("width"), F.col("tags").alias("tag_string"), (r % 11 == 0).alias("is_deleted"), (1 + r % 30).alias("commit_seq"),
    )
    sha = F.lower(F.hex("sha"))
    assets = m.select(r.alias("asset_id"), r, "post_id", sha.alias("sha256"))
    objects = m.where("sha IS NOT NULL").select(sha.alias("sha256")).distinct().select("sha256", (F.conv(F.substring("sha256", 1, 4), 16, 10).cast("long") + 1).alias("length"), F.when(~F.col("sha256").startswith("0"), F.lit("webp")).alias("stored_ext"))
    return Lake(objects, assets, observations, current_posts(observations, assets))


#: DuckDB's view of the same derivation.
LAKE_SQL = """
WITH m AS (SELECT DISTINCT row_id, sha, post_id, tags FROM members WHERE row_id IS NOT NULL),
observations AS (SELECT row_id, post_id, CASE row_id % 5 WHEN 0 THEN 'g' WHEN 1 THEN 's' WHEN 2 THEN 'q' WHEN 3 THEN 'e' END AS rating, CASE WHEN row_id % 17 <> 0 THEN row_id % 101 END AS score,
  100 + row_id % 3000 AS width, tags AS tag_string, row_id % 11 = 0 AS is_deleted, 1 + row_id % 30 AS commit_seq FROM m),
assets AS (SELECT row_id AS asset_id, row_id, post_id, lower(hex(sha)) AS sha256 FROM m),
objects AS (SELECT sha256, ('0x' || substr(sha256, 1, 4))::BIGINT + 1 AS length, CASE WHEN sha256 NOT LIKE '0%' THEN 'webp' END AS stored_ext FROM (SELECT DISTINCT sha256 FROM assets WHERE sha256 IS NOT NULL)),
current_posts AS (SELECT post_id, row_id, row_id AS asset_id FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY commit_seq DESC, row_id DESC) AS rn FROM observations WHERE post_id IS NOT NULL) WHERE rn = 1)
"""
