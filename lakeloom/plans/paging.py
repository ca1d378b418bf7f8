"""Ordered pages: a stable total order, keyset cursors, positions and k-way merges.

A page is a filter on the key after the cursor and a bounded sort: Spark keeps the best n rows of
each task and merges them, nothing is sorted as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.functions.runtime import global_positions

MAX_PAGE = 128


def post_order(descending: bool) -> list[Column]:
    """By post id, unknown ones last both ways; then source, page upwards, asset id in the direction."""
    post, asset = F.col("post_id"), F.col("asset_id")
    return [post.desc_nulls_last() if descending else post.asc_nulls_last(), F.col("source_id").asc(), F.col("page").asc(), asset.desc() if descending else asset.asc()]


def after(cursor: dict, keys: list[tuple[str, bool]]) -> Column:
    """Rows after the cursor in an order of (column, descending) with nulls last."""
    out, same = F.lit(False), F.lit(True)
    for name, descending in keys:
        v, c = cursor[name], F.col(name)
        later = F.lit(False) if v is None else (c.isNull() | ((c < v) if descending else (c > v)))
        out = out | (same & later)
        same = same & c.eqNullSafe(F.lit(v))
    return out


def page(rows: DataFrame, keys: list[tuple[str, bool]], size: int, cursor: dict | None = None) -> DataFrame:
    """The next size rows (and one more, which says that there are others) after the cursor."""
    if not 0 < size <= MAX_PAGE:
        raise ValueError("page size")
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in keys]
    return (rows if cursor is None else rows.where(after(cursor, keys))).orderBy(*order).limit(size + 1)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Several sources' rows as one, to be paged together."""
    return reduce(DataFrame.unionByName, parts)


def positions(rows: DataFrame, order: list[Column], group: list[str]) -> DataFrame:
    """rows with position (from 1) in the order within each group, numbered without a window over a
    whole group: bookmarks, locating by position and top n are filters on it."""
    placed = global_positions(rows, [*[F.col(g).asc_nulls_first() for g in group], *order], "__pos")
    if not group:
        return placed.withColumn("position", F.col("__pos") + 1).drop("__pos")
    first = placed.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min("__pos").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    return placed.join(first, same).select(*rows.columns, (F.col("__pos") - F.col("__first") + 1).alias("position"))


def evenly_spaced(count: int, picks: int) -> list[int]:
    """Positions of picks among count rows: both ends and even steps between."""
    if picks >= count:
        return list(range(count))
    return [0] if picks == 1 else [i * (count - 1) // (picks - 1) for i in range(picks)]
