"""Graphs by repeated joins: connected components, bounded depth, page coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeloom.functions.runtime import clear_stored, cut, stored
from lakeloom.operators.ranking import cover, nodes

#: Rounds after which a computation that should have settled is taken as faulty.
MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node is connected to.

    Alternates large-star and small-star steps, which settle in few rounds even on long chains; every
    step combines before its shuffle and its result is stored in the checkpoint folder, with what it left
    behind cleared. Edges that are stars about their least nodes already need no round. A node of many
    edges is an aggregate, never a list. Nodes without edges aren't in the edges and so not in the result."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links = stored(pairs.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(links):
            break
        links = _star_steps(links)
        clear_stored(edges.sparkSession)
    else:
        raise RuntimeError("components didn't settle")
    return nodes.join(links, nodes["node"] == links["hi"], "left").select("node", F.coalesce("lo", "node").alias("component"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each upper end of links (lo, hi; distinct) has one lower end, which is no upper end itself."""
    ends = links.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _star_steps(links: DataFrame) -> DataFrame:
    """Links after a large-star and a small-star step."""
    both = links.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(links.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    large = both.join(least, "x").where("y > x AND y <> m").select(F.col("m").alias("lo"), F.col("y").alias("hi"))
    large = large.union(least.where("x <> m").select(F.col("m").alias("lo"), F.col("x").alias("hi"))).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(low.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct()
    return stored(small)


def least_depths(roots: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(node, depth) of nodes within limit steps: edges (src, dst, step) from roots (node, depth).

    Only nodes whose depth fell go on in the next round, so that it ends with any steps of at least 0."""
    known = roots.groupBy("node").agg(F.min("depth").alias("depth")).where(F.col("depth") <= limit)
    fresh = known
    while True:
        reached = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("depth") + F.col("step")).alias("depth")).where(F.col("depth") <= limit)
        reached = reached.groupBy("node").agg(F.min("depth").alias("new"))
        better = reached.join(known, "node", "left").where("depth IS NULL OR new < depth").select("node", F.col("new").alias("depth"))
        fresh = cut(better)
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh).groupBy("node").agg(F.min("depth").alias("depth")))


def covering_page(asks: DataFrame, pages: DataFrame, now: int, fresh_for: int) -> DataFrame:
    """Of each ask (ask_id, scope, x) the freshest page (page_id, scope, lower, through, fetched) with
    lower <= x < through that isn't older than fresh_for; asks without one are left out.

    Only the freshest page of each node of a dyadic tree over the places is kept, and each place that is
    asked looks at the one node on every level that holds it: work grows with asks and pages times levels,
    however many pages lie over a place."""
    good = pages.where((F.col("fetched") >= now - fresh_for) & (F.col("lower") < F.col("through")))
    ends = good.agg(F.min("lower"), F.max("through")).first()  # two numbers
    if ends[0] is None:
        return asks.limit(0).join(good, "scope").select("ask_id", "page_id")
    base, last = ends[0], ends[1] - 1
    levels = (last - base).bit_length() + 1
    reach = good.select("scope", "page_id", "fetched", (F.col("lower").cast("long") - base).alias("a"), (F.col("through").cast("long") - 1 - base).alias("b"))
    best = reach.select("scope", "page_id", "fetched", F.explode(cover("a", "b", levels)).alias("node")).groupBy("scope", "node").agg(F.max(F.struct("fetched", "page_id")).alias("page"))
    places = asks.select("scope", "x").where(F.col("x").between(base, last)).distinct()
    held = places.select("scope", "x", F.explode(nodes(f"(CAST(x AS bigint) - {base})", levels)).alias("node")).join(best, ["scope", "node"])
    freshest = held.groupBy("scope", "x").agg(F.max("page").alias("page"))
    return asks.join(freshest, ["scope", "x"]).groupBy("ask_id").agg(F.max("page").getField("page_id").alias("page_id"))
