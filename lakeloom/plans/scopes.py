"""Set algebra on scopes (sets of keys) and versioned worksets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_EDITS = 1000


def add(selection: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    return selection.select(*key).unionByName(scope.select(*key)).distinct()


def remove(selection: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    return selection.select(*key).distinct().join(scope.select(*key), key, "left_anti")


def intersect(selection: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    return selection.select(*key).distinct().join(scope.select(*key), key, "left_semi")


def resolve(base: DataFrame, inclusions: DataFrame, exclusions: DataFrame, key: list[str]) -> DataFrame:
    """base and inclusions without exclusions; an inclusion counts even if excluded from the base."""
    return add(remove(base, exclusions, key), inclusions, key)


def at_revision(base: DataFrame, edits: DataFrame, key: list[str], revision: int) -> DataFrame:
    """Members at a revision: base with the edits (key, since, until, present) then valid applied."""
    valid = edits.where((F.col("since") <= revision) & (F.col("until").isNull() | (F.col("until") > revision)))
    return add(remove(base, valid, key), valid.where("present"), key)


def edit(edits: DataFrame, points: DataFrame, key: list[str], revision: int, expected: int, current: int) -> DataFrame:
    """Apply point edits (key, present) as a new revision; refused if another came in between."""
    if expected != current:
        raise ValueError(f"revision {current}, not {expected}")
    if points.limit(MAX_EDITS + 1).count() > MAX_EDITS:
        raise ValueError(f"more than {MAX_EDITS} edits")
    closed = edits.join(points.select(*key).withColumn("__hit", F.lit(True)), key, "left")
    closed = closed.withColumn("until", F.when(F.col("__hit") & F.col("until").isNull(), F.lit(revision)).otherwise(F.col("until"))).drop("__hit")
    return closed.unionByName(points.select(*key, F.lit(revision).alias("since"), F.lit(None).cast("int").alias("until"), "present"))


def directory_delta(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """(key, state): added, unchanged or gone."""
    a, b = before.select(*key).distinct().withColumn("a", F.lit(1)), now.select(*key).distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("unchanged")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with a side column; empty if they're equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
