"""Problem 7: fill containers of fixed capacity with texts, never splitting one that fits.

Only the histogram of lengths (at most capacity + 1 numbers) comes to the driver. There the
configuration linear program (which combinations of lengths fill a container, and how many
containers of each) is solved by multiplicative weights: every round prices the lengths by how far
they're covered, a bounded knapsack dynamic program finds the best-priced combination, and it gets as
many containers as the first of its lengths that is covered by them allows, so that a round ends for
good with some length. Rounding takes the whole containers of this fractional solution; what they
leave is a smaller program, solved in the same way with whole containers only, until nothing is left.
Every container thus comes from the program. The result is a short table of combinations; every item
finds its container from its place in the order by length.

In a round only one length of each group of neighbouring lengths, the least covered one, is priced:
lengths that lie close together do for each other, and a length that is left out now is the least
covered one of its group later. No length is ever left out of the program.

Defined results: a text longer than the capacity is cut into full containers and a rest, which is
packed like others; null and empty texts have no tokens and lie in container 0 with an empty range;
texts of equal length are ordered by doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeloom.functions.runtime import cut, global_positions, spread
from lakeloom.llm.tokens import token_count

#: Tokens in a container; how fast a covered length loses its price, what power of its size the price
#: begins with (above 1, so that long items are placed while short ones are there to fill up); groups.
CAPACITY, RATE, TILT, GROUPS = 2048, 0.02, 1.02, 24


def best_priced(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The combination of at most so many of each size within capacity that has the highest price: a
    knapsack over the whole axis of capacities, copies in binary parts."""
    value, steps = np.zeros(capacity + 1), []
    for s, p, n in zip(sizes.tolist(), prices.tolist(), most.tolist()):
        n, k = min(n, capacity // s), 1
        while n > 0:
            k = min(k, n)
            n -= k
            room = value[k * s :]
            total = value[: capacity + 1 - k * s] + p * k
            better = total > room
            np.copyto(room, total, where=better)
            steps.append((s, k, better))
            k *= 2
    out: dict[int, int] = {}
    c = capacity
    for s, k, better in reversed(steps):
        if c >= k * s and better[c - k * s]:
            out[s] = out.get(s, 0) + k
            c -= k * s
    return out


def least_covered(covered: np.ndarray, groups: int) -> np.ndarray:
    """The place of the least covered one of each of so many groups of neighbours."""
    n = len(covered)
    if n <= groups:
        return np.arange(n)
    group = np.arange(n) * groups // n
    order = np.lexsort((covered, group))
    return order[np.r_[True, group[order][1:] != group[order][:-1]]]


def solve_weights(histogram: dict[int, int], capacity: int, whole: bool = False) -> list[tuple[dict[int, int], float]]:
    """Containers per combination that cover every length exactly; whole: only whole containers."""
    sizes = np.array(sorted(s for s, n in histogram.items() if s > 0 and n > 0), np.int64)
    need = np.array([histogram[int(s)] for s in sizes], float)
    left, amounts = need.copy(), {}
    while len(pool := np.flatnonzero(left > 1e-9)):
        covered = 1 - left[pool] / need[pool]
        some = least_covered(covered, GROUPS)
        at = pool[some]
        config = best_priced(sizes[at], (sizes[at] / capacity) ** TILT * np.exp(-RATE * covered[some]), np.ceil(left[at] - 1e-9).astype(np.int64), capacity)
        at = np.searchsorted(sizes, list(config))
        used = np.array(list(config.values()), float)
        share = float((left[at] / used).min())
        share = float(max(1, int(share + 1e-9))) if whole else share
        left[at] -= share * used
        key = tuple(sorted(config.items()))
        amounts[key] = amounts.get(key, 0.0) + share
    return [(dict(k), x) for k, x in amounts.items()]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(items per length, containers) so that each item of the histogram lies in one container."""
    full = {capacity: histogram[capacity]} if histogram.get(capacity) else {}
    rest = {s: n for s, n in histogram.items() if 0 < s < capacity and n > 0}
    out: list[tuple[dict[int, int], int]] = [({s: 1}, n) for s, n in full.items()]
    for config, x in solve_weights(rest, capacity):
        n = int(x + 1e-9)
        if n:
            out.append((config, n))
            for s, k in config.items():
                rest[s] -= n * k
    return out + [(config, round(x)) for config, x in solve_weights(rest, capacity, whole=True)]


def slots(histogram: dict[int, int], configs: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, first container, items per container) of the runs of equal items, for items
    numbered from the longest to the shortest."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for config, n in configs:
        for s, k in config.items():
            runs.setdefault(s, []).append((base, k, n * k))
        base += n
    start, rows = 0, []
    for s in sorted((s for s, n in histogram.items() if s > 0 and n > 0), reverse=True):
        at = start
        for first, k, items in runs[s]:
            rows.append((at, first, k))
            at += items
        start += histogram[s]
    table = np.array(rows or [(0, 0, 1)], np.int64)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, key, start, end): the ranges of each item of the given size in containers."""
    sized = cut(items.select(F.col(key).alias("__key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = sized.select("__key", "n", F.explode(starts).alias("start")).select("__key", "start", F.least(F.col("n"), F.col("start") + capacity).alias("end"))
    pieces = pieces.withColumn("size", F.col("end") - F.col("start"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most capacity + 1 rows
    first, container, each = slots(histogram, configurations(histogram, capacity))

    @F.arrow_udf(T.LongType())
    def of_place(pos: pa.Array) -> pa.Array:
        p = pos.to_numpy()
        i = np.searchsorted(first, p, side="right") - 1
        return pa.array(container[i] + (p - first[i]) // each[i])

    placed = global_positions(pieces, [F.col("size").desc(), F.col("__key"), F.col("start")])
    where = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(of_place("pos"))
    return placed.select(where.alias("container_id"), F.col("__key").alias(key), "start", "end")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", token_count("text").alias("tokens"))
    return pack(documents, "doc_id", "tokens").select("container_id", "doc_id", F.col("start").alias("start_token"), F.col("end").alias("end_token"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the fewest containers that could hold so many tokens."""
    filled = p7_containers(spark, d).agg(F.countDistinct(F.when(F.col("end_token") > F.col("start_token"), F.col("container_id"))).alias("containers"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"))
    return filled.withColumn("bound", F.ceil(F.col("tokens") / CAPACITY))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
