"""The first few rows of each group, in two steps, so that no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts that a group's rows are spread over before the second step.
SALT = 32


def first_rows(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order, with place (from 1)."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SALT)))
    one = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))).where(F.col("__r") <= k).drop("__r", "__salt")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def first_k(rows: DataFrame, group: list[str], order: list[Column], k: int, value: Column, name: str) -> DataFrame:
    """(group..., name): the values of the first k rows of each group as an array in their order."""
    few = first_rows(rows, group, order, k).select(*group, F.struct("place", value.alias("v")).alias("s"))
    return few.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias(name))
