"""Problem 2: how often every distinct term occurs, and in how many records.

A global dictionary is built first (llm.dictionary). Each task then encodes the terms of its records by
it and adds them up in two count arrays, occurrences and records; the arrays are cut into ranges of
identifiers, and each range is summed over all tasks. No text is shuffled for counting, and a term that
is in every record costs one entry per task.

Rows are made distinct by (key, text) before, which splits a key with very many texts over all tasks.
Keys with several texts are found by comparing hashes; their terms are made distinct by (key, term) to
count records. Where the dictionary is too large for a copy on every executor, a task's block
dictionary is joined with it, and everything else stays the same.

Defined results: a record is a key; rows of one key that differ make one record with the terms of
all of them, equal rows count once; all rows without a key make one record. Null texts have no
terms and aren't in the number of records; empty ones are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.functions.runtime import cut
from lakeloom.llm import dictionary as D

#: Distinct terms of one block where the dictionary has no copies; keys that a join may broadcast.
BLOCK_TERMS, FEW_KEYS = 1_000_000, 1_000_000
#: The identifier under which the number of records is summed.
KNOWN = -1


def _presence(ids: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """The ids that each row has, once per row."""
    return np.unique(row * size + ids) % size if len(ids) else ids


def _count_arrays(held, size: int, separator: str):
    """Units (text, occ, rec, known) to count arrays of the task by the executor's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, occurrences, records, known = D.Encoder(held), np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            words, row = D.words_of(batch.column(0), separator)
            occ, rec = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            known += int(batch.column(3).to_numpy(zero_copy_only=False).sum())
            ids = encoder.ids(words)
            occurrences += np.bincount(ids[occ[row]], minlength=size)
            mine = rec[row]
            records += np.bincount(_presence(ids[mine], row[mine], max(size, 1)), minlength=size)
        used = np.flatnonzero(occurrences + records)
        yield D.ranged(used, occurrences[used], records[used])
        yield D.ranged(np.array([KNOWN]), np.zeros(1), np.array([known]))

    return run


def _block_terms(separator: str, most: int):
    """Units to (term, first, second) of block dictionaries; the number of records under a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        known, names = 0, ["term", "first", "second"]

        def merged() -> pa.Table:
            t = pa.concat_tables(parts).group_by("term").aggregate([("first", "sum"), ("second", "sum")])
            return t.select(["term", "first_sum", "second_sum"]).rename_columns(names)

        for batch in batches:
            words, row = D.words_of(batch.column(0), separator)
            occ, rec = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            known += int(batch.column(3).to_numpy(zero_copy_only=False).sum())
            coded = words.dictionary_encode()
            ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            first = np.bincount(ids[occ[row]], minlength=size)
            second = np.bincount(_presence(ids[rec[row]], row[rec[row]], max(size, 1)), minlength=size)
            parts.append(pa.table([coded.dictionary.cast(pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names))
            if sum(map(len, parts)) > 2 * most:
                parts = [merged()]
                if len(parts[0]) > most:
                    yield from parts[0].to_batches()
                    parts = []
        if parts:
            yield from merged().to_batches(max_chunksize=50_000)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([known], pa.int64())], names)

    return run


def _to_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        sums = np.zeros((2, len(ids)), np.int64)
        for k in (0, 1):
            np.add.at(sums[k], at, batch.column(k + 1).to_numpy())
        yield D.ranged(ids, *sums)


def _units(rows: DataFrame, separator: str) -> DataFrame:
    """(text, occ, rec, known) of rows (k, t): each distinct row once for occurrences; for records the row
    itself if it's the only one of its key, else one row per term of the key."""
    one, two = F.xxhash64(F.col("t").isNull(), "t"), F.xxhash64(F.lit("second"), F.col("t").isNull(), "t")
    differ = rows.groupBy("k").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.min(two).alias("c"), F.max(two).alias("d")).where("a <> b OR c <> d")
    several = cut(differ.select(F.col("k").alias("__k")))
    few = several.limit(FEW_KEYS + 1).count()
    texts = rows.distinct()
    flags = lambda df, occ, rec, known: df.select(F.col("t").alias("text"), *[F.lit(x).alias(n) if isinstance(x, bool) else x.alias(n) for n, x in (("occ", occ), ("rec", rec), ("known", known))])
    if not few:
        return flags(texts, True, True, F.col("t").isNotNull())
    side = F.broadcast(several) if few <= FEW_KEYS else several
    same = texts["k"].eqNullSafe(side["__k"])
    single, multi = texts.join(side, same, "left_anti"), texts.join(side, same, "left_semi")
    terms = multi.select("k", F.explode(F.split("t", separator)).alias("t")).where("t <> ''").distinct()
    known = multi.where("t IS NOT NULL").select("k").distinct().withColumn("t", F.lit(""))
    parts = [flags(single, True, True, F.col("t").isNotNull()), flags(multi, True, False, False), flags(terms, False, True, False), flags(known, False, False, True)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def term_counts(rows: DataFrame, key: str, text: str, separator: str = " ") -> DataFrame:
    """(term_id, term, occurrences, records) of every term; of the row whose term is null, records
    is the number of records whose text isn't null. Written once to the checkpoint folder."""
    pairs = rows.select(F.col(key).alias("k"), F.col(text).alias("t"))
    words = D.build(pairs, "t", separator)
    units = _units(pairs, separator)
    if words.held is not None:
        arrays = units.mapInArrow(_count_arrays(words.held, words.size, separator), D.ARRAYS)
    else:
        blocks = units.mapInArrow(_block_terms(separator, BLOCK_TERMS), "term string, first long, second long")
        coded = blocks.where("term IS NOT NULL").join(words.entries, "term").select("id", "first", "second")
        coded = coded.union(blocks.where("term IS NULL").select(F.lit(KNOWN).cast("long").alias("id"), "first", "second"))
        arrays = coded.mapInArrow(_to_arrays, D.ARRAYS)
    sums = cut(D.sum_arrays(arrays))
    named = sums.join(words.entries, "id", "left")
    return named.select(F.col("id").alias("term_id"), "term", F.col("first").alias("occurrences"), F.col("second").alias("records"))


def marked_terms(rows: DataFrame, key: str, text: str, requested: DataFrame, rare_below: int = 3, common_part: int = 5) -> DataFrame:
    """(term, occurrences, records, mark): rare in fewer than rare_below records (else common in more
    than 1/common_part of the known ones), null for a useful one; with the requested terms that
    no record has."""
    counts = term_counts(rows, key, text)
    known = counts.where(F.col("term_id") == KNOWN).agg(F.sum("records")).first()[0] or 0  # one number
    counts = counts.where(F.col("term_id") != KNOWN).select("term", "occurrences", "records")
    wanted = requested.toDF("term").where("term IS NOT NULL AND term <> '' AND NOT contains(term, ' ')").distinct()
    absent = wanted.join(counts.select("term"), "term", "left_anti").select("term", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_part > F.lit(known), "common")
    return counts.union(absent).withColumn("mark", mark)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    members = spark.read.parquet(f"{d}/members.parquet")
    return marked_terms(members, "row_id", "tags", spark.read.parquet(f"{d}/requested_tags.parquet").select("tag"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where(F.col("mark").isNotNull()).select(F.col("term").alias("tag"), "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select(F.col("term").alias("tag"), "occurrences", "records", "mark")


_COUNTED = r"""
WITH m AS (SELECT DISTINCT row_id, tags FROM members),
t AS (SELECT row_id, unnest(string_split(tags, ' ')) AS tag FROM m),
c AS (SELECT tag, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM t WHERE tag <> '' GROUP BY tag),
n AS (SELECT count(DISTINCT row_id) AS known FROM m WHERE tags IS NOT NULL),
r AS (SELECT DISTINCT tag FROM requested_tags WHERE tag IS NOT NULL AND tag <> '' AND NOT contains(tag, ' ') AND tag NOT IN (SELECT tag FROM c)),
a AS (SELECT * FROM c UNION ALL SELECT tag, 0, 0 FROM r)
SELECT tag, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > known THEN 'common' END AS mark FROM a, n
"""
SQL = {"p2_counts": _COUNTED, "p2_found": f"SELECT tag, mark FROM ({_COUNTED}) WHERE mark IS NOT NULL"}
QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
