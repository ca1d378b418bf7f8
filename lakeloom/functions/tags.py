"""Tag strings: tokens, postings, dictionary, fingerprints, and hints as bit masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def tokens(col: str) -> Column:
    """The distinct tokens of a string split at single spaces, sorted, without empty ones; null for null."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.col(col), " "), lambda t: t != "")))


def postings(rows: DataFrame, key: str, col: str) -> DataFrame:
    """(tag, key) without repeats within a row."""
    return rows.select(key, F.explode(tokens(col)).alias("tag")).select("tag", key)


def dictionary(rows: DataFrame, col: str) -> DataFrame:
    """(tag, n): every tag with the number of rows that have it."""
    return rows.select(F.explode(tokens(col)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def fingerprint(col: str) -> Column:
    """The same for all spellings of one set of tags; null for null."""
    return F.when(F.col(col).isNotNull(), F.sha2(F.to_json(tokens(col)), 256))


def mask(col: str, hints: dict[str, int]) -> Column:
    """Bits of the hints among a row's tags."""
    found = F.split(F.col(col), " ")
    bits = [F.when(F.array_contains(found, t), F.lit(b)).otherwise(F.lit(0)) for t, b in hints.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)
