"""The global dictionary of a corpus: every distinct term with an integer, in code point order.

The dictionary is built first: each task sends its distinct terms once, they are sorted by range over
all tasks and numbered. Where it's small (its terms and bytes are counted before) every executor gets
a copy and texts become arrays of integers where they lie; beyond that, terms are encoded by a join
with the dictionary. Count arrays over the integers are kept per block and summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from lakeloom.functions.runtime import global_positions

#: Size up to which executors get a copy of a dictionary; terms that a task holds before it sends them;
#: identifiers in one range of count arrays.
MOST_TERMS, MOST_BYTES, HELD_TERMS, RANGE = 500_000, 32 << 20, 1_000_000, 4096


@dataclass(frozen=True)
class Dictionary:
    """entries (term, id), written once; their number; a copy for executors, or None if it's too large."""

    entries: DataFrame
    size: int
    held: Broadcast | None


def words_of(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end without empty ones, and the row of each; a null text has none."""
    lists = pc.split_pattern(texts.cast(pa.string()), separator)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) if not lists.null_count else np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    flat = lists.flatten()
    used = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(used)), row[used]


def _distinct(separator: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Array] = []

        def merged() -> pa.Array:
            return pc.unique(pa.chunked_array(parts or [pa.array([], pa.string())])).cast(pa.string())

        def out(terms: pa.Array) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([terms.slice(at, 50_000)], ["term"])

        for batch in batches:
            parts.append(pc.unique(words_of(batch.column(0), separator)[0]))
            if sum(map(len, parts)) > most:
                parts = [merged()]
                if len(parts[0]) > most // 2:
                    yield from out(parts[0])
                    parts = []
        yield from out(merged())

    return run


def build(rows: DataFrame, text: str, separator: str = " ") -> Dictionary:
    """The dictionary of all words of a text column."""
    found = rows.select(F.col(text)).mapInArrow(_distinct(separator, HELD_TERMS), "term string").distinct()
    entries = global_positions(found, [F.col("term")], "id")
    size, volume = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    held = None
    if size <= MOST_TERMS and volume <= MOST_BYTES:
        terms = entries.select("id", "term").toArrow().sort_by("id").column("term").combine_chunks().cast(pa.string())
        held = rows.sparkSession.sparkContext.broadcast(terms)
    return Dictionary(entries, size, held)


class Encoder:
    """Words to integers by an executor's copy; the lookup table is made once per Python worker."""

    _tables: dict[int, tuple[pa.Array, dict[str, int]]] = {}

    def __init__(self, held: Broadcast) -> None:
        terms = held.value
        if id(terms) not in self._tables:  # the array is kept with its table, so that its id stays its own
            if len(self._tables) >= 2:
                self._tables.clear()
            self._tables[id(terms)] = (terms, {t: i for i, t in enumerate(terms.to_pylist())})
        self.table = self._tables[id(terms)][1]

    def ids(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        table = self.table
        own = np.array([table[t] for t in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


#: Schema of count arrays: a range of identifiers, places within it, and two counts for each.
ARRAYS = "part long, places array<int>, first array<long>, second array<long>"


def ranged(ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Counts of sorted identifiers as arrays by range."""
    part = ids // RANGE
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(ids) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(ids)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((ids % RANGE).astype(np.int32), first.astype(np.int64), second.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), *lists], ["part", "places", "first", "second"])


def sum_arrays(arrays: DataFrame) -> DataFrame:
    """(id, first, second): the arrays of all blocks summed by identifier range."""
    return arrays.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(_sum_arrays, "id long, first long, second long")


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, sums, seen = None, np.zeros((2, RANGE), np.int64), np.zeros(RANGE, bool)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(at + (part or 0) * RANGE), pa.array(sums[0, at]), pa.array(sums[1, at])], ["id", "first", "second"])

    for batch in batches:
        parts, ends = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
        ends = ends - ends[0]
        places, first, second = (batch.column(k).flatten().to_numpy() for k in (1, 2, 3))
        for k, p in enumerate(parts.tolist()):
            if p != part:
                if part is not None:
                    yield out()
                part, sums, seen = p, np.zeros((2, RANGE), np.int64), np.zeros(RANGE, bool)
            own = slice(ends[k], ends[k + 1])
            np.add.at(sums[0], places[own], first[own])
            np.add.at(sums[1], places[own], second[own])
            seen[places[own]] = True
    if part is not None:
        yield out()
