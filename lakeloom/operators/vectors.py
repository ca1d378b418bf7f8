"""Vectors and perceptual hashes: exact and probed nearest neighbours, Hamming search, the ledger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Vectors the centroids are fitted on, at most; lists at most; vectors for which an index is worth it.
FIT, MAX_LISTS, LEAST_ROWS = 50_000, 4096, 256
#: Rows and queries that one task multiplies; hashes of one byte value above which a second key is used.
SLICE_ROWS, SLICE_QUERIES, HOT = 50_000, 20_000, 2000


def normalised(col: str) -> Column:
    """The unit vector as doubles; null for an empty, zero or unfinite one."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    ok = (F.size(v) > 0) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x / n))


def valid(rows: DataFrame, col: str, dimension: int) -> DataFrame:
    """Only rows whose vector has the dimension, is finite and isn't zero."""
    return rows.where((F.size(col) == dimension) & normalised(col).isNotNull())


def nearest(rows: DataFrame, key: str, col: str, query: list[float], k: int, prefilter: Column | None = None) -> DataFrame:
    """(key, distance) of the k nearest by cosine distance, ties by key: a filter, an expression and a
    bounded sort."""
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q)
    literal = F.array(*[F.lit(float(x)) for x in q])
    rows = rows if prefilter is None else rows.where(prefilter)
    dot = F.aggregate(F.zip_with(F.col("__u"), literal, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    found = rows.select(key, normalised(col).alias("__u")).where("__u IS NOT NULL").select(key, (1 - dot).alias("distance"))
    return found.orderBy("distance", key).limit(k)


def fit_centroids(rows: DataFrame, col: str, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids fitted on at most FIT vectors, a bounded sample by hash; every row is indexed."""
    total = rows.count()
    share = min(1.0, 1.2 * FIT / max(total, 1))
    sample = rows.select(normalised(col).alias("u")).where("u IS NOT NULL")
    chosen = sample.where(F.pmod(F.xxhash64("u"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(FIT).toPandas()["u"]
    x = np.stack([np.asarray(v) for v in chosen]) if len(chosen) else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.maximum(n, 1e-12), c)
    return c


def lists_for(rows: int) -> int:
    """Lists of an index over so many rows."""
    return 1 if rows < LEAST_ROWS else max(1, min(MAX_LISTS, int(rows**0.5), rows // 32))


def indexed(rows: DataFrame, key: str, col: str, centroids: np.ndarray) -> DataFrame:
    """(key, u, list): every row with its unit vector and nearest centroid, to be written by list."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["list"] = (np.stack(b["u"].to_numpy()) @ centroids.T).argmax(1)
                yield b[[key, "u", "list"]]

    unit = rows.select(key, normalised(col).alias("u")).where("u IS NOT NULL")
    kind = dict(rows.dtypes)[key]
    return unit.mapInPandas(assign, f"`{key}` {kind}, u array<double>, list long")


def probe(index: DataFrame, key: str, centroids: np.ndarray, query: list[float], k: int, probes: int) -> DataFrame:
    """The k nearest among the lists whose centroids are nearest; only these lists are read."""
    q = np.asarray(query, float)
    near = np.argsort(-(centroids @ (q / np.linalg.norm(q))))[:probes]
    return nearest(index.where(F.col("list").isin([int(x) for x in near])), key, "u", query, k)


def batch_nearest(queries: DataFrame, index: DataFrame, key: str, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query, key, distance, rank): the k nearest of many queries (query, u), each probing some lists.

    Each list is cut into slices of at most about SLICE_ROWS rows and SLICE_QUERIES queries by hash, from
    its own size (at most MAX_LISTS numbers). A task multiplies one slice of rows with one of
    queries and keeps k of each query; these few candidates are merged by query."""
    q_kind, k_kind = dict(queries.dtypes)["query"], dict(index.dtypes)[key]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(np.stack(b["u"].to_numpy()) @ centroids.T), axis=1)[:, :probes]
                yield pd.DataFrame({"query": np.repeat(b["query"].to_numpy(), near.shape[1]), "q": np.repeat(b["u"].to_numpy(), near.shape[1]), "list": near.ravel()})

    asks = queries.select("query", "u").mapInPandas(lists, f"query {q_kind}, q array<double>, list long")
    sizes = lambda df, n: {r[0]: -(-r[1] // n) for r in df.groupBy("list").count().collect()}  # noqa: E731 - at most MAX_LISTS rows
    in_slices, in_parts = sizes(index, SLICE_ROWS), sizes(asks, SLICE_QUERIES)
    of = lambda d: F.coalesce(F.try_element_at(F.create_map(*[x for k, n in d.items() for x in (F.lit(k), F.lit(int(n)))]), F.col("list")), F.lit(1)) if any(n > 1 for n in d.values()) else F.lit(1)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = asks.withColumn("part", F.pmod(F.xxhash64("query"), of(in_parts)).cast("int")).withColumn("slice", each(of(in_slices)))
    rows = index.withColumn("slice", F.pmod(F.xxhash64(key), of(in_slices)).cast("int")).withColumn("part", each(of(in_parts)))

    def multiply(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(r):
            r = r.sort_values(key, kind="stable")
            u, keys = np.stack(r["u"].to_numpy()), r[key].to_numpy()
            for at in range(0, len(a), 512):
                d = 1 - np.stack(a["q"].to_numpy()[at : at + 512]) @ u.T
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                out.append(pd.DataFrame({"query": np.repeat(a["query"].to_numpy()[at : at + 512], n), key: keys[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], key: [], "distance": []})

    groups = ["list", "slice", "part"]
    found = asks.groupBy(*groups).cogroup(rows.groupBy(*groups)).applyInPandas(multiply, f"query {q_kind}, `{key}` {k_kind}, distance double")
    w = Window.partitionBy("query").orderBy("distance", key)  # at most k * probes * slices rows each
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_for(asked: DataFrame, index: DataFrame, key: str, centroids: np.ndarray, k: int, recall: float = 0.95, sample: int = 200) -> int:
    """The fewest probes with which at most sample queries (query, u), by hash, find the share recall of their
    exact k nearest: each neighbour needs as many probes as its list is far down the query's order of lists."""
    some = asked.orderBy(F.xxhash64("query")).limit(sample)
    one = np.zeros((1, centroids.shape[1]))
    exact = batch_nearest(some, index.select(key, "u", F.lit(0).cast("long").alias("list")), key, one, k, 1).select("query", key)
    where = exact.join(index.select(key, "list"), key).join(some, "query").select("u", "list").toPandas()  # at most sample * k rows
    if not len(where):
        return 1
    order = np.argsort(-(np.stack(where["u"].to_numpy()) @ centroids.T), axis=1)
    needed = np.sort((order == where["list"].to_numpy()[:, None]).argmax(axis=1) + 1)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def sign_hash(col: str) -> Column:
    """64 bits: the signs of the first 64 components."""
    return F.aggregate(F.slice(col, 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def hamming_classes(rows: DataFrame, key: str, col: str) -> tuple[DataFrame, DataFrame]:
    """(classes (hash, rep, n), members (key, rep)): rows of one hash are one class with its least key."""
    classes = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("hash")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    members = rows.join(classes.select(F.col("hash").alias(col), "rep"), col).select(key, "rep")
    return classes, members


def hamming_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of class representatives within radius <= 7.

    Two such hashes share one of their 8 bytes. Where more than HOT hashes share a byte value, they must
    also share one of eight blocks of 7 bits of the rest, and these are joined by both; a pair is kept
    only by the first byte and block that it shares, so that it's met once. The hot byte values are
    counted first (at most 2,048) and broadcast."""
    if not 0 <= radius <= 7:
        raise ValueError("radius")
    byte = F.expr("shiftrightunsigned(hash, 8 * band) & 255")
    base = classes.select("rep", "hash", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("band")).withColumn("bits", byte)
    hot = base.groupBy("band", "bits").count().where(F.col("count") > HOT).select("band", "bits", F.lit(True).alias("hot"))
    rest = "((CASE WHEN band = 7 THEN 0L ELSE shiftleft(shiftrightunsigned({0}, 8 * (band + 1)), 8 * band) END) | ({0} & (shiftleft(1L, 8 * band) - 1)))"
    blocks = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(-1)))
    keyed = base.join(F.broadcast(hot), ["band", "bits"], "left").withColumn("block", F.explode(blocks))
    keyed = keyed.withColumn("more", F.expr(f"IF(block < 0, 0L, shiftrightunsigned({rest.format('hash')}, 7 * block) & 127)"))
    keys = ["band", "bits", "block", "more"]
    left = keyed.select(*keys, F.col("rep").alias("a"), F.col("hash").alias("ha"))
    right = keyed.select(*keys, F.col("rep").alias("b"), F.col("hash").alias("hb"))
    met = left.join(right, keys).where("a < b").withColumn("x", F.col("ha").bitwiseXOR(F.col("hb"))).withColumn("distance", F.bit_count("x"))
    first_byte = F.expr("filter(sequence(0, 7), k -> (shiftrightunsigned(x, 8 * k) & 255) = 0)[0]")
    first_block = F.expr(f"IF(block < 0, -1, filter(sequence(0, 7), k -> (shiftrightunsigned({rest.format('x')}, 7 * k) & 127) = 0)[0])")
    return met.where((F.col("distance") <= radius) & (first_byte == F.col("band")) & (first_block == F.col("block"))).select("a", "b", "distance")


def append_new(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh whose key the table doesn't hold, each once."""
    return fresh.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def coverage(discovered: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(source, recipe, discovered, succeeded, failed, pending) of discovered (source, recipe, object_id)
    and the latest of outcomes (recipe, object_id, at, ok)."""
    latest = outcomes.groupBy("recipe", "object_id").agg(F.max_by("ok", "at").alias("ok"))
    joined = discovered.distinct().join(latest, ["recipe", "object_id"], "left")
    return joined.groupBy("source", "recipe").agg(F.count("*").alias("discovered"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("pending"))


def byte_batches(items: DataFrame, order: list[str], size: str, limit: int) -> DataFrame:
    """items with batch, rising in the order: consecutive items of at most limit together, or one larger item.

    The running size is cut into cells of limit; the items that lie within a cell are a batch, and one
    that crosses into the next is a batch of its own, so that all batches come from one running sum."""
    from lakeloom.functions.stats import running_totals

    summed = running_totals(items.withColumn("__one", F.lit(0)), ["__one"], [F.col(c) for c in order], size, "bigint")
    crosses = F.when(F.col("before") % limit + F.col(size) > limit, 1).otherwise(0)
    return summed.withColumn("batch", F.floor(F.col("before") / limit).cast("long") * 2 + crosses).drop("__one", "before", "total")


def sources_updated(table: DataFrame, found: DataFrame, key: str, sources: str) -> DataFrame:
    """table with the sorted source ids of found (key, sources) where they differ; changed tells which rows."""
    new = found.select(F.col(key).alias("__k"), F.array_sort(F.array_distinct(sources)).alias("__s"))
    joined = table.join(new, F.col(key) == F.col("__k"), "left")
    differ = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(F.col(sources))
    return joined.withColumn("changed", differ).withColumn(sources, F.when(differ, F.col("__s")).otherwise(F.col(sources))).drop("__k", "__s")


def kept_versions(versions: list[tuple[int, int]], pinned: set[int], now: int, keep: int = 8, age: int = 168 * 3600) -> list[int]:
    """Of (version, second of its making) those to keep: the newest keep, all younger than age, pinned ones."""
    newest = {v for v, _ in sorted(versions)[-keep:]} if keep else set()
    return sorted(v for v, at in versions if v in newest or v in pinned or now - at < age)


def planned(discovered: DataFrame, outcomes: DataFrame, recipes: list[str]) -> DataFrame:
    """(object_id, recipes): what is still to be done for each discovered object; objects for which every
    recipe has an outcome aren't in it, so that nothing of them is read."""
    wanted = discovered.select("object_id").distinct().select("object_id", F.explode(F.array(*map(F.lit, recipes))).alias("recipe"))
    left = wanted.join(outcomes.where("ok").select("object_id", "recipe"), ["object_id", "recipe"], "left_anti")
    return left.groupBy("object_id").agg(F.array_sort(F.collect_set("recipe")).alias("recipes"))
