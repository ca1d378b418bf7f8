"""Ranks of rows within their own time windows, for any number of windows in one pass.

Rows are counted by (group, value, time, window) first, so that a value that very many rows share is
at most one row per moment, and these are sorted by (group, value) over all tasks, once. How many rows
with a smaller value lie in a window is then the sum of two counts: those in lower ranges of values,
from histograms over time that are summed along the ranges (one array per range), and those in the
same range, from a wavelet matrix over time in numpy. Work grows with rows times the logarithm of the
number of moments, whatever the sizes of groups and windows; no row is copied into windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lakeloom.functions.runtime import stored

#: Rows of the table of totals that a join may broadcast.
FEW = 2000


class Span(NamedTuple):
    """A window of each row: the columns of its first and last moment, and the column of the class whose
    rows count in it (None: all rows of the group)."""

    name: str
    lo: str
    hi: str
    cls: str | None = None


class Moments:
    """Weighted moments in a fixed order, for sums over the first r of those at or before a moment."""

    def __init__(self, t: np.ndarray, w: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = bits
        for bit in range(bits - 1, -1, -1):
            zero = (t >> bit & 1) == 0
            before = np.r_[0, np.cumsum(zero)]
            self.levels.append((before, np.r_[0, np.cumsum(np.where(zero, w, 0))], int(before[-1])))
            order = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
            t, w = t[order], w[order]

    def until(self, r: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The weight of the first r with a moment of at most last (-1 or more)."""
        x = np.minimum(last + 1, (1 << self.bits) - 1)
        lo, hi, out = np.zeros(len(r), np.int64), r.astype(np.int64), np.zeros(len(r), np.int64)
        for (before, weight, zeros), bit in zip(self.levels, range(self.bits - 1, -1, -1)):
            one = (x >> bit & 1).astype(bool)
            out += np.where(one, weight[hi] - weight[lo], 0)
            lo = np.where(one, zeros + lo - before[lo], before[lo])
            hi = np.where(one, zeros + hi - before[hi], before[hi])
        return out


def _below(days: int):
    """Histogram rows (key, part, t, w) sorted by key and part to (key, part, below): what lies in lower
    parts, cumulated over time; under part -1 the whole of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, total, own = None, None, np.zeros(days, np.int64), np.zeros(days, np.int64)

        def out(key: str, part: int, array: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key]), "part": pa.array([part], pa.int32()), "below": pa.array([np.cumsum(array)], pa.list_(pa.int64()))})

        for batch in batches:
            keys, parts = batch.column(0), batch.column(1).to_numpy()
            t, w = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            starts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)]) if len(parts) else []
            for a, b in zip(starts, [*starts[1:], len(parts)]):
                k, p = keys[int(a)].as_py(), int(parts[a])
                if (k, p) != (key, part):
                    total += own
                    own = np.zeros(days, np.int64)
                    if k != key:
                        if key is not None:
                            yield out(key, -1, total)
                        total = np.zeros(days, np.int64)
                    key, part = k, p
                    yield out(key, part, total)
                np.add.at(own, t[a:b], w[a:b])
        if key is not None:
            yield out(key, -1, total + own)

    return run


def _rank_part(spans: list[tuple[str, str, str, str]], days: int):
    """One part's points and the histograms below it to counts of less and equal for each span."""
    bits = max(1, int(days).bit_length())

    def run(points: pa.Table, below: pa.Table) -> pa.Table:
        n = len(points)
        points = points.combine_chunks()
        if not n:
            return points.select(["id"]).append_column("counts", pa.array([], pa.list_(pa.int64())))
        order = pc.sort_indices(points, [("code", "ascending")])
        points = points.take(order)
        code, t, w = (points.column(c).to_numpy() for c in ("code", "t", "w"))
        known = {k: np.asarray(b.values, np.int64) for k, b in zip(below.column("key").to_pylist(), below.column("below").combine_chunks())} if len(below) else {}
        counts = np.full((n, 2 * len(spans)), -1, np.int64)
        matrices: dict[str, list] = {}
        for s, (_, lo, hi, key) in enumerate(spans):
            if key not in matrices:
                coded = points.column(key).combine_chunks().dictionary_encode()
                at = coded.indices.fill_null(-1).to_numpy()
                matrices[key] = []
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    own = np.flatnonzero(at == k)
                    matrices[key].append((name, own, Moments(t[own], w[own], bits)))
            first, last = (points.column(c).to_numpy() for c in (lo, hi))
            for name, own, moments in matrices[key]:
                values = code[own]
                a, b = np.clip(first[own], 0, days) - 1, np.clip(last[own], -1, days - 1)
                ends = [np.searchsorted(values, values, side=x) for x in ("left", "right")]
                less, through = (np.maximum(moments.until(r, b) - moments.until(r, np.minimum(a, b)), 0) for r in ends)
                under = np.r_[0, known[name]]
                counts[own, 2 * s] = less + np.maximum(under[b + 1] - under[np.minimum(a, b) + 1], 0)
                counts[own, 2 * s + 1] = through - less
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * len(spans), pa.int32()), pa.array(counts.reshape(-1)))
        return pa.table([points.column("id"), lists], ["id", "counts"])

    return run


def window_ranks(rows: DataFrame, group: list[str], t: str, value: str, spans: list[Span], weight: str | None = None) -> DataFrame:
    """rows with, for each span, <name>_n, <name>_less and <name>_equal: how many rows of the group (and of
    the row's own class) lie at moments lo..hi, and how many of them have a smaller or the same value.

    Moments are whole numbers in the unit in which windows are told apart (days, say: there's one array
    entry for each between the first and last). Rows with a null value or moment aren't counted and get
    nulls; so do rows of a null class, for its spans. weight: the column of how often each row counts."""
    names = [c for s in spans for c in (f"{s.name}_n", f"{s.name}_less", f"{s.name}_equal")]
    known = rows.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    ends = known.agg(F.min(t), F.max(t)).first()  # two numbers
    if ends[0] is None:
        return rows.withColumns({c: F.lit(None).cast("long") for c in names})
    base, days = int(ends[0]), int(ends[1] - ends[0]) + 1
    classes = sorted({s.cls for s in spans if s.cls})
    edges = sorted({c for s in spans for c in (s.lo, s.hi)})
    own = [*group, value, t, *edges, *classes]
    points = known.groupBy(*own).agg((F.count("*") if weight is None else F.sum(weight)).alias("__w"))
    keys = [F.col(g).asc_nulls_first() for g in group] + [F.col(value).asc()]
    ordered = points.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ordered.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    of = lambda c: F.when(F.lit(True) if c is None else F.col(c).isNotNull(), F.to_json(F.struct(F.lit(c or "").alias("of"), *[F.col(g).alias(f"g_{g}") for g in group], *([F.col(c).alias("cls")] if c else [])), {"ignoreNullFields": "false"}))
    key_of = {c: f"__key_{k}" for k, c in enumerate([None, *classes]) if c or any(s.cls is None for s in spans)}
    keyed = placed.withColumns({k: of(c) for c, k in key_of.items()})
    moment = lambda c: (F.col(c) - F.lit(base)).cast("long")
    hist = keyed.select(F.explode(F.array(*key_of.values())).alias("key"), F.col("__part").alias("part"), moment(t).alias("t"), F.col("__w").alias("w")).where("key IS NOT NULL")
    hist = hist.groupBy("key", "part", "t").agg(F.sum("w").alias("w"))
    below = stored(hist.repartition(F.col("key")).sortWithinPartitions("key", "part").mapInArrow(_below(days), "key string, part int, below array<long>"))
    # the code of a row is the first id of its value, as ids follow the order of (group, value)
    code = F.min("__id").over(Window.partitionBy("__part", *group, value))
    left = keyed.select(F.col("__part").alias("part"), F.col("__id").alias("id"), code.alias("code"), moment(t).alias("t"), F.col("__w").alias("w"), *[moment(c).alias(f"__e_{c}") for c in edges], *key_of.values())
    part_spans = [(s.name, f"__e_{s.lo}", f"__e_{s.hi}", key_of[s.cls]) for s in spans]
    ranked = left.groupBy("part").cogroup(below.where("part >= 0").groupBy("part")).applyInArrow(_rank_part(part_spans, days), "id long, counts array<long>")
    wide = keyed.join(ranked.withColumnRenamed("id", "__id"), "__id")
    totals = below.where("part < 0").select(F.col("key").alias("__tk"), "below")
    few = totals.limit(FEW + 1).count() <= FEW
    out = wide
    for c, k in key_of.items():
        side = totals.select(F.col("__tk").alias(f"__tk{k}"), F.col("below").alias(f"__all{k}"))
        out = out.join(F.broadcast(side) if few else side, F.col(k) == F.col(f"__tk{k}"), "left")
    cols = {}
    upto = lambda k, c: F.when(c < 0, F.lit(0)).otherwise(F.element_at(F.col(f"__all{k}"), F.least(c, F.lit(days - 1)).cast("int") + 1))
    for i, s in enumerate(spans):
        k = key_of[s.cls]
        ok = F.col(k).isNotNull()
        cols[f"{s.name}_n"] = F.when(ok, F.greatest(F.lit(0).cast("long"), upto(k, moment(s.hi)) - upto(k, moment(s.lo) - 1)))
        cols[f"{s.name}_less"] = F.when(ok, F.col("counts")[2 * i])
        cols[f"{s.name}_equal"] = F.when(ok, F.col("counts")[2 * i + 1])
    found = out.select(*[F.col(c).alias(f"__o_{c}") for c in own], *[v.alias(c) for c, v in cols.items()])
    same = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in own]
    return rows.join(found, same, "left").drop(*[f"__o_{c}" for c in own])


def window_medians(rows: DataFrame, keys: list[str], lo: str, hi: str, points: DataFrame, t: str, m: str, cap: int = 81, weight: str | None = None) -> DataFrame:
    """rows with median: of the positive values m of the points of the same keys at moments lo..hi, each at
    most cap (so that only the order below it matters); the mean of the two middle ones of an even number,
    null for none. Points are counted by (keys, t, m) first, windows are distinct (keys, lo, hi): the table
    of one key has at most cap rows for each moment, however many points there are. weight: the column of
    how often each point counts."""
    counted = points.where(F.col(m) > 0).groupBy(*keys, F.col(t).alias("t"), F.least(F.col(m), F.lit(cap)).cast("int").alias("m")).agg((F.count("*") if weight is None else F.sum(weight)).alias("w"))
    asked = rows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
    kind = dict(rows.dtypes)
    fields = ", ".join(f"`{k}` {kind[k]}" for k in keys)

    def run(a: pa.Table, p: pa.Table) -> pa.Table:
        lo_, hi_ = (a.column(c).to_numpy() for c in ("lo", "hi"))
        median = np.full(len(a), np.nan)
        if len(p) and len(a):
            t_, m_, w_ = (p.column(c).to_numpy() for c in ("t", "m", "w"))
            moments = np.unique(t_)
            table = np.zeros((len(moments) + 1, cap + 1), np.int64)  # points before each moment by value
            np.add.at(table, (np.searchsorted(moments, t_) + 1, m_), w_)
            table = np.cumsum(np.cumsum(table, axis=0), axis=1)
            inside = table[np.searchsorted(moments, hi_, side="right")] - table[np.searchsorted(moments, lo_, side="left")]
            n = inside[:, -1]
            middle = [(inside < k[:, None]).sum(axis=1) for k in ((n + 1) // 2, n // 2 + 1)]
            median = np.where(n > 0, (middle[0] + middle[1]) / 2, np.nan)
        return a.select([*keys, "lo", "hi"]).append_column("median", pa.array(median, from_pandas=True))

    found = asked.groupBy(*keys).cogroup(counted.groupBy(*keys)).applyInArrow(run, f"{fields}, lo {kind[lo]}, hi {kind[hi]}, median double")
    found = found.withColumnsRenamed({k: f"__{k}" for k in keys} | {"lo": "__lo", "hi": "__hi"})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(lo) == F.col("__lo"), F.col(hi) == F.col("__hi")]
    return rows.join(found, same, "left").drop("__lo", "__hi", *[f"__{k}" for k in keys])
