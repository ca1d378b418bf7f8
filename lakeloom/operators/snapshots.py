"""Problem 4: what changed between consecutive full snapshots.

Wide rows are reduced to compact ones first: the position of the snapshot, a 128-bit hash of stream and
key, one of the values, and the key. A shuffle by that hash makes buckets; in each, numpy sorts the
compact arrays and searchsorted looks for every key in the snapshot before and after its own. A stream's
key may be in any number of snapshots: a task holds one bucket's rows and, of the key that goes on in
the next bucket, two rows. Full values are read again only for the keys that differ: a filter of
bounded size over their hashes drops all other rows before anything is shuffled.

Defined results: of several rows of a key in a snapshot the latest counts (a null time is the
earliest; of equal times the one with the greater value hash); rows without a key or of an unknown
or unfinished snapshot count for nothing; null differs from ''; a stream with a null part of its
key is a stream like others; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeloom.functions.payloads import canonical_json
from lakeloom.functions.runtime import cut, global_positions

#: Compact rows sorted at once, a parameter of memory only; snapshots whose table a join may broadcast;
#: bits of the filter over the hashes of differing keys.
BUCKET_ROWS, FEW_SNAPSHOTS, FILTER_BITS = 300_000, 500_000, 1 << 27


def hash128(cols: list[Column], prefix: str) -> list[Column]:
    """Two independent 64-bit hashes of the columns; null differs from every value."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias(f"{prefix}1"), F.xxhash64(F.lit(prefix), *parts).alias(f"{prefix}2")]


def ordered_snapshots(scans: DataFrame, stream: list[str], scan: str, at: str) -> DataFrame:
    """(scan, pos, stream, first, last): snapshots numbered so that consecutive ones of a stream have
    consecutive positions, the stream's number, and whether each is the first or last of it."""
    rows = scans.select(*stream, scan, at).distinct().groupBy(*stream, scan).agg(F.max(at).alias(at))
    order = [F.col(c).asc_nulls_first() for c in (*stream, at, scan)]
    placed = global_positions(rows, order)
    ends = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in stream]).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    joined = placed.join(ends, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in stream])
    return cut(joined.select(scan, "pos", F.col("first").alias("stream"), (F.col("pos") == F.col("first")).alias("first"), (F.col("pos") == F.col("last")).alias("last")))


def latest_rows(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, at: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """The rows that count, one of each key and position, sorted by both."""
    order = np.lexsort((v2, v1, at, pos, k2, k1))
    k1, k2, pos = k1[order], k2[order], pos[order]
    return order[np.r_[(k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (pos[1:] != pos[:-1]), True]] if len(order) else order


def compare_bucket(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position it is reported at, change) as three arrays, for rows sorted by key and position,
    one of each."""
    new_key = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
    key = np.cumsum(new_key) - 1
    code = key * (int(pos.max(initial=0)) + 3) + pos + 1

    def found(at_code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(code, at_code), len(code) - 1)
        return i, code[i] == at_code

    before, had = found(code - 1)
    _, stays = found(code + 1)
    added = np.flatnonzero(~had & ~first)
    removed = np.flatnonzero(~stays & ~last)
    changed = np.flatnonzero(had & ~first & ((v1 != v1[before]) | (v2 != v2[before])))
    rows = np.r_[added, removed, changed]
    kinds = np.repeat(np.array(["added", "removed", "changed"], object), [len(added), len(removed), len(changed)])
    return rows, pos[rows] + (kinds == "removed"), kinds


def _buckets(most: int):
    """Compact rows sorted by key and position to (k1, k2, key, pos, change).

    What is held from one bucket to the next is the last row, which may be replaced or stay alone
    still, and the row before it if that's of the same key; that one has been reported already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, known = 0, 0  # known: whether the first held row has been reported
        names = ["k1", "k2", "key", "pos", "change"]

        def bucket(t: pa.Table, known: int, final: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch], int]:
            k1, k2, pos, at, v1, v2 = (t.column(c).to_numpy() for c in ("k1", "k2", "pos", "at", "v1", "v2"))
            t = t.take(pa.array(latest_rows(k1, k2, pos, at, v1, v2)))
            k1, k2, pos, v1, v2 = (t.column(c).to_numpy() for c in ("k1", "k2", "pos", "v1", "v2"))
            first, last = (t.column(c).to_numpy().astype(bool) for c in ("first", "last"))
            row, place, kind = compare_bucket(k1, k2, pos, first, last, v1, v2)
            mine = (row >= known) & ((row < len(t) - 1) | final)
            row, place, kind = row[mine], place[mine], kind[mine]
            keys = t.column("key").take(pa.array(row)).combine_chunks()
            out = pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, pa.array(place), pa.array(kind, pa.string())], names)
            before = len(t) > 1 and k1[-1] == k1[-2] and k2[-1] == k2[-2]
            return out, t.slice(len(t) - 1 - before).combine_chunks().to_batches(), int(before)

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= most:
                out, held, known = bucket(pa.Table.from_batches(held), known, False)
                rows = sum(map(len, held))
                yield out
        if rows:
            yield bucket(pa.Table.from_batches(held), known, True)[0]

    return run


def _latest_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the rows that a later row of the same key and snapshot replaces, within each batch."""
    for batch in batches:
        k1, k2, pos, at, v1, v2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "k2", "pos", "at", "v1", "v2"))
        order = np.lexsort((v2, v1, at, pos, k2, k1))
        same = np.zeros(len(order), bool)
        same[:-1] = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1]) & (pos[order][1:] == pos[order][:-1])
        yield batch.take(pa.array(order[~same]))


def snapshot_changes(
    scans: DataFrame, rows: DataFrame, stream: list[str], scan: str, scan_at: str, key: str, row_at: str, values: list[str], json_values: dict[str, tuple[str, ...]], retrieve: list[str]
) -> DataFrame:
    """(prev_<scan>, <scan>, <key>, change, retrieve...) of consecutive snapshots.

    values are compared by code point, json_values as JSON without the named top-level members.
    retrieve: columns whose full values come along, of the later snapshot (removed: the earlier).
    """
    snapshots = ordered_snapshots(scans, stream, scan, scan_at)
    few = snapshots.limit(FEW_SNAPSHOTS + 1).count() <= FEW_SNAPSHOTS
    small = lambda df: F.broadcast(df) if few else df
    keyed = rows.where(F.col(key).isNotNull() & F.col(scan).isNotNull())
    texts = [F.col(v) for v in values] + [canonical_json(j, skip) for j, skip in json_values.items()]
    at = F.coalesce(F.unix_micros(row_at), F.lit(-(2**63)))
    plain = keyed.select(scan, key, row_at, *[t.alias(f"t{i}") for i, t in enumerate(texts)])
    compact = plain.select(scan, F.col(key).alias("key"), at.alias("at"), *hash128([F.col(f"t{i}") for i in range(len(texts))], "v"))
    placed = compact.join(small(snapshots), scan).select(*hash128([F.col("stream"), F.col("key")], "k"), "key", "pos", "first", "last", "at", "v1", "v2")
    latest = placed.mapInArrow(_latest_in_batch, placed.schema)
    kind = placed.schema["key"].dataType.simpleString()
    changes = latest.repartition(F.col("k1"), F.col("k2")).sortWithinPartitions("k1", "k2", "pos").mapInArrow(_buckets(BUCKET_ROWS), f"k1 long, k2 long, key {kind}, pos long, change string")
    changes = cut(changes) if retrieve else changes
    position = lambda name, pos: small(snapshots.select(F.col(scan).alias(name), F.col("pos").alias(pos)))
    named = changes.withColumn("prev", F.col("pos") - 1).join(position("to_scan", "pos"), "pos").join(position("from_scan", "prev"), "prev")
    told = [F.col("from_scan").alias(f"prev_{scan}"), F.col("to_scan").alias(scan), F.col("key").alias(key), F.col("change")]
    if not retrieve:
        return named.select(*told)
    named = named.withColumn("of_scan", F.when(F.col("change") == "removed", F.col("from_scan")).otherwise(F.col("to_scan")))
    asked = named.select("of_scan", "key")
    some = keyed.where(hash_filter(asked, ["of_scan", "key"])(F.xxhash64(F.col(scan), F.col(key))))
    full = some.select(F.col(scan).alias("of_scan"), F.col(key).alias("key"), at.alias("__at"), F.struct(*[F.col(c) for c in retrieve]).alias("full"))
    found = named.join(full, ["of_scan", "key"]).groupBy("from_scan", "to_scan", "key", "change").agg(F.max_by("full", "__at").alias("full"))
    return found.select(*told, *[F.col(f"full.{c}").alias(c) for c in retrieve])


def hash_filter(keys: DataFrame, columns: list[str]):
    """A function of the hash of columns that is true for all rows of keys and for few others: a field of
    FILTER_BITS bits, built by an aggregate of words and sent to every executor (16 MB)."""
    place = f"pmod(xxhash64({', '.join(f'`{c}`' for c in columns)}), {FILTER_BITS})"
    words = keys.select(F.expr(f"CAST({place} div 64 AS int)").alias("w"), F.expr(f"shiftleft(1L, CAST({place} % 64 AS int))").alias("b"))
    own = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most FILTER_BITS / 64 rows
    field = np.zeros(FILTER_BITS // 64, np.int64)
    field[own.column("w").to_numpy()] = own.column("b").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(T.BooleanType())
    def may_hold(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy() % FILTER_BITS
        return pa.array((sent.value[at // 64] >> (at % 64) & 1).astype(bool))

    return may_hold


def _pins(spark: SparkSession, d: str, retrieve: list[str]) -> DataFrame:
    scans = spark.read.parquet(f"{d}/pinterest_streams.parquet").where("state = 'exhausted'")
    return snapshot_changes(
        scans, spark.read.parquet(f"{d}/pinterest_stream_pins.parquet"), ["entrypoint", "subject_id"], "scan_id", "updated_at", "pin_id", "observed_at",
        ["title", "description", "image_signature", "board_id"], {"fields_json": ("counts", "tracking")}, retrieve,
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pins(spark, d, [])


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return _pins(spark, d, ["title", "description", "image_signature", "board_id", "fields_json"])
