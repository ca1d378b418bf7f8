"""Versions of the lake: reads at a commit, validity intervals, change sets, deltas, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakeloom.plans.spec import QuerySpec, compile_spec
from lakeloom.sources.lake import Lake, current_posts


def as_of(lake: Lake, seq: int) -> Lake:
    """The lake as it was at a commit: later observations and what only they bring aren't there."""
    seen = lake.observations.where(F.col("commit_seq") <= seq)
    assets = lake.assets.join(seen.select("row_id"), "row_id", "left_semi")
    objects = lake.objects.join(assets.select("sha256"), "sha256", "left_semi")
    return Lake(objects, assets, seen, current_posts(seen, assets))


def post_intervals(observations: DataFrame, keep: list[str]) -> DataFrame:
    """(post_id, valid_from, valid_until, row_id, keep...): the winner of each post over the commits.

    Within a commit the greatest row wins; a row that an earlier winner of the same commit order beats
    never appears. The first step is an aggregate by (post, commit), so that only one row of each
    goes through the window by post."""
    per_commit = observations.where("post_id IS NOT NULL").groupBy("post_id", "commit_seq").agg(F.max(F.struct("row_id", *keep)).alias("r"))
    w = Window.partitionBy("post_id").orderBy("commit_seq")
    return per_commit.select("post_id", F.col("commit_seq").alias("valid_from"), F.lead("commit_seq").over(w).alias("valid_until"), "r.row_id", *[F.col(f"r.{c}").alias(c) for c in keep])


def at(intervals: DataFrame, seq: int) -> DataFrame:
    """The rows of an interval table that are valid at a commit."""
    return intervals.where((F.col("valid_from") <= seq) & (F.col("valid_until").isNull() | (F.col("valid_until") > seq)))


def changed_objects(lake: Lake, after: int, until: int) -> DataFrame:
    """(sha256) whose answer may differ between two commits: objects of new rows, and objects of
    every asset of the posts that got new rows (their winner, or their any-observation match, moved)."""
    fresh = lake.observations.where((F.col("commit_seq") > after) & (F.col("commit_seq") <= until))
    direct = lake.assets.join(fresh.select("row_id"), "row_id", "left_semi").select("sha256")
    through_posts = lake.assets.join(fresh.where("post_id IS NOT NULL").select("post_id"), "post_id", "left_semi").select("sha256")
    return direct.unionByName(through_posts).where("sha256 IS NOT NULL").distinct()


def delta(spec: QuerySpec, lake: Lake, before: DataFrame, after: int, until: int) -> DataFrame:
    """The result at commit until from the one at after: only changed objects are evaluated again."""
    changed = changed_objects(lake, after, until)
    kept = before.join(changed, "sha256", "left_anti")
    return kept.unionByName(compile_spec(spec, as_of(lake, until), changed=changed))


def member_intervals(old: DataFrame, now: DataFrame, revision: int) -> DataFrame:
    """Versioned members (sha256, since, until) after a new result: gone ones closed, new ones opened."""
    open_, closed = old.where("until IS NULL"), old.where("until IS NOT NULL")
    still = open_.join(now, "sha256", "left_semi")
    gone = open_.join(now, "sha256", "left_anti").withColumn("until", F.lit(revision).cast("long"))
    new = now.join(open_, "sha256", "left_anti").select("sha256", F.lit(revision).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    return closed.unionByName(still).unionByName(gone).unionByName(new)


def continuous(known: dict, now: dict) -> bool:
    """Whether a delta is allowed: the same generation, the anchor batch where it was, no gap."""
    seqs = now["seqs"]
    return known["generation"] == now["generation"] and now["batches"].get(known["seq"]) == known["batch"] and sorted(seqs) == list(range(min(seqs), max(seqs) + 1))


def vacuum(intervals: DataFrame, newest: int, pinned: list[int], keep: int = 64) -> DataFrame:
    """Drop versions that ended before the last keep commits and that no lease still reads."""
    oldest = min([newest - keep + 1, *pinned])
    return intervals.where(F.col("valid_until").isNull() | (F.col("valid_until") > oldest))


def accept(accepted: DataFrame, batch: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows of a batch that aren't accepted yet; a replay adds nothing, a repeat within it counts once."""
    once = batch.dropDuplicates([key, fingerprint])
    return once.join(accepted.select(key, fingerprint), [key, fingerprint], "left_anti")
