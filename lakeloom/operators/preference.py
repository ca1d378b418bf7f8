"""Statistics of comparisons: pairs of tiered batches, Borda and Davidson fits, ranks, stability.

A fit goes over the pairs with aggregates only: in each round every item's gradient and curvature
are sums over its pairs, computed where the pairs lie; scores are joined back by item. No item or
rating is gathered in one task, and a component only up to LOCAL_PAIRS pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeloom.functions.runtime import clear_stored, stored
from lakeloom.functions.stats import midranks
from lakeloom.operators.graphs import components

#: Members of a batch as a rule; the fit's default regularisation, strength of ties and tolerance.
MAX_BATCH, REGULAR, TIES, TOLERANCE = 16, 0.1, 1.0, 1e-5
#: Distinct pairs of a component up to which its fit runs in numpy; beyond, every round is a distributed job.
LOCAL_PAIRS = 100_000
#: Pairs after which a task that looks for components merges them, and items that it holds at most (about).
FOREST_ROWS, FOREST_ITEMS = 100_000, 500_000


def pairs(batches: DataFrame) -> DataFrame:
    """(batch, i, j, y, w) of batches (batch, tiers): every two members in the order of their tiers,
    y 1 if the first lies in a better tier and a half in the same, each batch weighing as much.

    A batch of any size is expanded exactly, at a cost that is quadratic in it; who makes the batches
    bounds them."""
    flat = F.flatten(F.transform("tiers", lambda t, k: F.transform(t, lambda m: F.struct(k.alias("tier"), m.alias("item")))))
    m = batches.select("batch", flat.alias("m")).withColumn("n", F.size("m")).where("n > 1")
    firsts = m.select("batch", "m", "n", F.posexplode("m").alias("p", "a"))
    both = firsts.select("batch", "n", "a", F.explode(F.slice("m", F.col("p") + 2, F.col("n"))).alias("b"))
    y = F.when(F.col("a.tier") < F.col("b.tier"), 1.0).otherwise(0.5)
    return both.select("batch", F.col("a.item").alias("i"), F.col("b.item").alias("j"), y.alias("y"), (2.0 / (F.col("n") * (F.col("n") - 1))).alias("w"))


def both_ways(p: DataFrame) -> DataFrame:
    """Each pair from either member's side: (batch, item, other, y, w)."""
    return p.select("batch", F.col("i").alias("item"), F.col("j").alias("other"), "y", "w").unionByName(p.select("batch", F.col("j").alias("item"), F.col("i").alias("other"), (1 - F.col("y")).alias("y"), "w"))


def borda(p: DataFrame) -> DataFrame:
    """(item, score, exposures): the mean over an item's batches of its mean result there."""
    per = both_ways(p).groupBy("item", "batch").agg(F.avg("y").alias("y"))
    return per.groupBy("item").agg(F.avg("y").alias("score"), F.count("*").alias("exposures"))


def outcome(d: Column, ties: float) -> tuple[Column, Column]:
    """Expected result and its variance for half the difference of scores d, with ties."""
    win, loss, tie = F.exp(d), F.exp(-d), F.lit(float(ties))
    z = win + loss + tie
    mean = (win + tie / 2) / z
    return mean, (win + tie / 4) / z - mean * mean


def davidson(p: DataFrame, regular: float = REGULAR, ties: float = TIES, rounds: int = 128, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """(item, score, component): the regularised maximum-likelihood scores with ties, by damped
    diagonal Newton steps, centred within each component of the comparison graph. A fit that doesn't
    settle within the rounds is an error if strict, else returned as it is.

    Components don't affect each other: those of at most LOCAL_PAIRS pairs are fitted whole, many together
    in a task, and only for larger ones every round is a distributed job."""
    p = p.where("i IS NOT NULL AND j IS NOT NULL")
    kind = dict(p.dtypes)["i"]
    forest = stored(p.select("i", "j").mapInArrow(_forest, f"i {kind}, j {kind}"))
    parts = stored(components(forest, "i", "j").withColumnRenamed("node", "item"))
    swap = F.col("i") > F.col("j")
    one = p.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("w") * F.when(swap, 1 - F.col("y")).otherwise(F.col("y"))).alias("wy"), "w")
    sums = one.repartition("i").groupBy("i", "j").agg(F.sum("wy").alias("wy"), F.sum("w").alias("w"))
    known = stored(sums.join(parts.withColumnRenamed("item", "i"), "i").select("component", "i", "j", "wy", "w"))
    large = stored(known.groupBy("component").count().where(F.col("count") > LOCAL_PAIRS).select("component"))
    none = large.isEmpty()
    whole = (known if none else known.join(large, "component", "left_anti")).repartition("component").sortWithinPartitions("component")
    fitted = whole.mapInArrow(_fitted(regular, ties, rounds, tolerance, strict, LOCAL_PAIRS), f"item {kind}, score double, component {kind}")
    if none:
        return fitted
    rest = known.join(large, "component", "left_semi")
    sides = stored(rest.select(F.col("i").alias("item"), F.col("j").alias("other"), "wy", "w").unionByName(rest.select(F.col("j").alias("item"), F.col("i").alias("other"), (F.col("w") - F.col("wy")).alias("wy"), "w")))
    return fitted.unionByName(_davidson_rounds(sides, parts.join(large, "component", "left_semi"), regular, ties, rounds, tolerance, strict))


def _davidson_rounds(sides: DataFrame, parts: DataFrame, regular: float, ties: float, rounds: int, tolerance: float, strict: bool) -> DataFrame:
    """The rounds of davidson as distributed jobs, for components of any size. What a round leaves behind is
    cleared before the next, so that neither disk nor the driver's memory grows with the rounds."""
    s = stored(parts.select("item", "component", F.lit(0.0).alias("score")))
    for _ in range(rounds):
        s, largest = _davidson_round(sides, s, regular, ties)
        clear_stored(sides.sparkSession)
        if largest is None or largest < tolerance:
            return s.select("item", "score", "component")
    if strict:
        raise RuntimeError(f"the fit didn't settle in {rounds} rounds")
    return s.select("item", "score", "component")


def _davidson_round(sides: DataFrame, s: DataFrame, regular: float, ties: float) -> tuple[DataFrame, float | None]:
    """Scores (item, component, score) after one more round, and the largest step in it."""
    other = s.select(F.col("item").alias("other"), F.col("score").alias("t"))
    mean, var = outcome((F.col("score") - F.col("t")) / 2, ties)
    met = sides.join(other, "other").join(s, "item")  # by item at last, as the sums are
    sums = met.groupBy("item").agg(F.first("component").alias("component"), F.first("score").alias("score"), F.sum(F.col("wy") - F.col("w") * mean).alias("g"), F.sum(F.col("w") * var).alias("c"))
    step = 0.9 * (F.col("g") - regular * F.col("score")) / (F.col("c") + regular)
    moved = stored(sums.select("item", "component", (F.col("score") + step).alias("score"), F.abs(step).alias("step")))
    ends = stored(moved.groupBy("component").agg(F.avg("score").alias("mean"), F.max("step").alias("step")))
    largest = ends.agg(F.max("step")).first()[0]
    return moved.drop("step").join(ends.drop("step"), "component").select("item", "component", (F.col("score") - F.col("mean")).alias("score")), largest


def _coded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The places of columns i and j among the distinct items of both, and those items."""
    both = pa.chunked_array([*t.column("i").chunks, *t.column("j").chunks]).combine_chunks().dictionary_encode()
    at = both.indices.to_numpy()
    return at[: len(t)], at[len(t) :], both.dictionary


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (i, j) to as few that connect the same items: each item with the least one of its component among
    the pairs of a partition, or of as much of it as has FOREST_ITEMS items."""

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, items = _coded(pa.Table.from_batches(held))
        order = pc.sort_indices(items).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = root = np.arange(len(order))
        a, b, items = rank[a], rank[b], items.take(pa.array(order))
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([items.take(pa.array(root)), items], schema=held[0].schema)

    held, n, least = [], 0, FOREST_ROWS
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n < least:
            continue
        held = [merged(held)]
        n = len(held[0])
        if n >= FOREST_ITEMS:
            yield held.pop()
            n = 0
        least = max(2 * n, FOREST_ROWS)
    if n:
        yield merged(held)


def _fitted(regular: float, ties: float, rounds: int, tolerance: float, strict: bool, most: int):
    """Pairs (component, i, j, wy, w) sorted by component to scores: the rounds of davidson in numpy, for
    about as many components at once as have most pairs. Each stops when it has settled by itself."""

    def fit(t: pa.Table) -> pa.RecordBatch:
        i, j, items = _coded(t)
        parts = t.column("component").combine_chunks().dictionary_encode()
        n, k, of = len(items), len(parts.dictionary), parts.indices.to_numpy()
        w, wy, s = t.column("w").to_numpy(), t.column("wy").to_numpy(), np.zeros(n)
        group, live = np.zeros(n, np.int64), np.ones(k, bool)
        group[i], group[j] = of, of
        members = np.bincount(group, minlength=k)
        for _ in range(rounds):
            win = np.exp((s[i] - s[j]) / 2)
            z = win + 1 / win + ties
            mean = (win + ties / 2) / z
            var = (win + ties / 4) / z - mean * mean
            g = np.bincount(i, wy - w * mean, n) - np.bincount(j, wy - w * mean, n)
            c = np.bincount(i, w * var, n) + np.bincount(j, w * var, n)
            step = 0.9 * (g - regular * s) / (c + regular)
            moved = s + step
            moved -= (np.bincount(group, moved, k) / members)[group]
            s = np.where(live[group], moved, s)
            largest = np.zeros(k)
            np.maximum.at(largest, group, np.abs(step))
            live &= largest >= tolerance
            if not live.any():
                break
        else:
            if strict:
                raise RuntimeError(f"the fit didn't settle in {rounds} rounds")
        return pa.RecordBatch.from_arrays([items, pa.array(s), parts.dictionary.take(pa.array(group))], ["item", "score", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n < max(most, 1):
                continue
            t = pa.Table.from_batches(held)
            parts = t.column("component")
            end = pc.index(parts, parts[n - 1]).as_py()  # the last component may go on
            if end:
                yield fit(t.slice(0, end))
            held, n = t.slice(end).to_batches(), n - end
        if n:
            yield fit(pa.Table.from_batches(held))

    return run


def tied_ranks(scores: DataFrame, group: list[str], score: str, grid: float = 1e-6) -> DataFrame:
    """scores with lo, hi and percentile: the places of the tied group, best first, on a grid."""
    at = scores.withColumn("__s", F.round(F.col(score) / grid).cast("long"))
    placed = midranks(at, group, "__s")
    size = at.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.count("__s").alias("__n"))
    tied = at.groupBy(*[F.col(g).alias(f"__t{g}") for g in group], F.col("__s").alias("__v")).agg(F.count("*").alias("__k"))
    out = placed.join(size, [F.col(g) == F.col(f"__{g}") for g in group]).join(tied, [*[F.col(g) == F.col(f"__t{g}") for g in group], F.col("__s") == F.col("__v")])
    above = F.round((1 - F.col("percentile")) * F.col("__n") - F.col("__k") / 2).cast("long")
    return out.select(*scores.columns, (above + 1).alias("lo"), (above + F.col("__k")).alias("hi"), "percentile")


def diversity(p: DataFrame) -> DataFrame:
    """(item, opponents): how many others an item met, by linear counting on 64 bits."""
    bits = both_ways(p).groupBy("item").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("other"), F.lit(64)).cast("int"))).alias("bits"))
    full = F.bit_count("bits")
    return bits.select("item", F.when(full < 64, -64 * F.log(1 - full / 64)).otherwise(F.lit(64 * 4.2)).alias("opponents"))


def compare_snapshots(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Per group: common items, correlation and mean distance of percentiles, and the overlap of the
    best tenth as a Jaccard ratio. a, b: (item, group, percentile)."""
    both = a.withColumnRenamed("percentile", "p").join(b.withColumnRenamed("percentile", "q"), ["item", group])
    top_a, top_b = F.col("p") >= 0.9, F.col("q") >= 0.9
    return both.groupBy(group).agg(
        F.count("*").alias("n"), F.corr("p", "q").alias("correlation"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("distance"),
        (F.count_if(top_a & top_b) / F.nullif(F.count_if(top_a | top_b), F.lit(0))).alias("jaccard"),
    )


def split_half(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batches in two halves by a hash of their number."""
    half = F.pmod(F.xxhash64("batch"), F.lit(2))
    return batches.where(half == 0), batches.where(half == 1)


def residuals(p: DataFrame, scores: DataFrame, ties: float = TIES) -> DataFrame:
    """(item, disagreement): the weighted mean distance of an item's results from those its score expects."""
    own, other = scores.select(F.col("item").alias("__a"), F.col("score").alias("__s")), scores.select(F.col("item").alias("__b"), F.col("score").alias("__t"))
    sides = both_ways(p).join(own, F.col("item") == F.col("__a")).join(other, F.col("other") == F.col("__b"))
    mean, _ = outcome((F.col("__s") - F.col("__t")) / 2, ties)
    return sides.groupBy("item").agg((F.sum(F.col("w") * F.abs(F.col("y") - mean)) / F.sum("w")).alias("disagreement"))


def stability(batches: DataFrame) -> DataFrame:
    """(items, distance): the mean distance of the percentiles that two halves of the batches give."""
    halves = [midranks(borda(pairs(h)).withColumn("g", F.lit(1)), ["g"], "score").select("item", F.col("percentile").alias(n)) for h, n in zip(split_half(batches), "ab")]
    return halves[0].join(halves[1], "item").agg(F.count("*").alias("items"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("distance"))


def sensitivity(p: DataFrame) -> DataFrame:
    """(batch, influence): the mean distance by which its items' mean results would move without a batch;
    items that are in no other batch don't count."""
    per = both_ways(p).groupBy("item", "batch").agg(F.avg("y").alias("y"))
    whole = per.groupBy(F.col("item").alias("__i")).agg(F.sum("y").alias("sum"), F.count("*").alias("n")).where("n > 1")
    moved = per.join(whole, F.col("item") == F.col("__i"))
    return moved.groupBy("batch").agg(F.avg(F.abs(F.col("sum") / F.col("n") - (F.col("sum") - F.col("y")) / (F.col("n") - 1))).alias("influence"))


def parsed_judgements(rows: DataFrame, kind: str) -> DataFrame:
    """(batch, tiers, elite, problem) of JSON judgements (batch, asked, text): unreadable, incomplete (not
    exactly the asked items), repeated, or elite items that weren't judged; null for a good one."""
    v = F.from_json("text", f"struct<tiers:array<array<{kind}>>,elite:array<{kind}>>", {"mode": "PERMISSIVE"})
    x = rows.withColumn("v", v).withColumn("all", F.flatten("v.tiers"))
    same = (F.size(F.array_except("all", "asked")) == 0) & (F.size(F.array_except("asked", "all")) == 0)
    problem = F.when(F.col("all").isNull(), "unreadable").when(~same, "incomplete").when(F.size("all") != F.size(F.array_distinct("all")), "repeated").when(F.size(F.array_except(F.coalesce("v.elite", F.array().cast(f"array<{kind}>")), "all")) > 0, "elite")
    return x.select("batch", "v.tiers", "v.elite", problem.alias("problem"))


def latest_review(reviews: DataFrame, until: int) -> DataFrame:
    """(ordinal, decision): each item's last decision at a watermark."""
    seen = reviews.where(F.col("seq") <= until)
    return seen.groupBy("ordinal").agg(F.max_by("decision", "seq").alias("decision"))


def even_batches(items: DataFrame, key: str, size: int = MAX_BATCH) -> DataFrame:
    """items with batch: all of them by key in batches of size, of which the last takes what is left over
    (so at most 2 * size - 1 members, and no item is alone unless it's the only one)."""
    from lakeloom.functions.runtime import global_positions

    placed = global_positions(items, [F.col(key)])
    last = max(placed.count() // size, 1) - 1
    return placed.withColumn("batch", F.least(F.floor(F.col("pos") / size), F.lit(last)).cast("long")).drop("pos")


def next_batches(items: DataFrame, percentile: str, key: str, seed: str, size: int = MAX_BATCH) -> DataFrame:
    """(key, batch, place): items put together with neighbours in percentile for the next comparison;
    windows of 4 * size neighbours are shuffled by a hash and cut into batches of size."""
    from lakeloom.functions.runtime import global_positions

    placed = global_positions(items.select(key, percentile), [F.col(percentile), F.col(key)])
    window = F.floor(F.col("pos") / (4 * size))
    order = Window.partitionBy("__w").orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)  # at most 4 * size rows each
    mixed = placed.withColumn("__w", window).withColumn("__r", F.row_number().over(order) - 1)
    return mixed.select(key, (F.col("__w") * 4 + F.floor(F.col("__r") / size)).cast("long").alias("batch"), (F.col("__r") % size).alias("place"))
