"""Order statistics of populations that are cut into few, large groups.

A window over such a group would be one task. Here rows are first counted by (group, value); the
distinct values are sorted by range over all tasks, summed up within each task, and the tasks' totals
(one row each) give the offsets. Then the results are joined back by (group, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeloom.functions.runtime import stored


def running_totals(rows: DataFrame, group: list[str], order: list[Column], weight: str, kind: str = "double") -> DataFrame:
    """rows with before (the weight of the group's earlier rows) and total (the whole group's)."""
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    placed = stored(ordered.withColumn("__part", F.shiftright("__id", 33)))
    own = Window.partitionBy("__part", *group).orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    ids = [f"__{g}" for g in group]
    totals = placed.groupBy(F.col("__part").alias("__in"), *[F.col(g).alias(f"__{g}") for g in group]).agg(F.sum(weight).alias("__sum"))  # a row for each task a group spans
    earlier = Window.partitionBy(*ids).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(kind)
    offsets = totals.select("__in", *ids, F.coalesce(F.sum("__sum").over(earlier).cast(kind), zero).alias("__offset"), F.sum("__sum").over(Window.partitionBy(*ids)).cast(kind).alias("total"))
    local = placed.withColumn("__local", F.coalesce(F.sum(weight).over(own).cast(kind), zero))
    same = [F.col("__part") == F.col("__in"), *[F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]]
    return local.join(offsets, same).select(*rows.columns, (F.col("__offset") + F.col("__local")).alias("before"), "total")


def midranks(rows: DataFrame, group: list[str], value: str, weight: str | None = None, name: str = "percentile") -> DataFrame:
    """rows with the mid-rank percentile of value in its group: (less + half of equal) / all, counts
    or weights. A null value has a null percentile and isn't counted."""
    w = F.count("*") if weight is None else F.sum(weight)
    ties = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(w.cast("double").alias("__w"))
    ranked = running_totals(ties, group, [F.col(value).asc()], "__w")
    pct = ranked.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(value).alias("__v"), ((F.col("before") + F.col("__w") / 2) / F.col("total")).alias(name))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col(value) == F.col("__v")]
    return rows.join(pct, same, "left").drop("__v", *[f"__{g}" for g in group])


def effective_size(weight: str) -> Column:
    """(sum of weights) squared over the sum of squared weights."""
    return F.sum(weight) ** 2 / F.sum(F.col(weight) ** 2)


def bucket(lower: Column, upper: Column, edges: list[int]) -> Column:
    """The index of the half-open interval between edges that holds both bounds, or null; the last
    interval has no upper edge."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges))):
        inside = lower >= edges[i]
        if i + 1 < len(edges):
            inside = inside & (upper < edges[i + 1])
        out = F.when(inside, i).otherwise(out)
    return F.when(upper < 0, F.lit(None)).otherwise(out)


def shrunk(p: Column, n: Column, support: Column, k: Column) -> Column:
    """A percentile drawn to a half by the size of its cohort, and above it by its own support."""
    q = 0.5 + n / (n + 1000) * (p - 0.5)
    return F.when(q <= 0.5, q).otherwise(0.5 + support / (support + k) * (q - 0.5))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
