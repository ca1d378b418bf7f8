"""Problem 5: items that appear together, by stripes.

Items are integers of a global dictionary (llm.dictionary); texts become integers where they lie, and
only these are shuffled, once, by basket. Each task turns its baskets into stripes: per item an
associative array of the later items beside it with counts, summed over the task's baskets. Stripes
are cut into ranges of neighbours and merged by (item, range), so that the stripe of a frequent
item is spread over tasks; then the log-likelihood ratio is applied. A basket of many items is cut
into segments of bounded size, and each two segments of it are a unit of work of their own.

Items that no qualifying pair can hold are left out first, exactly: a pair's count is at most the
smaller item's count, so min_count and min_lift bound the counts of both items.

Defined results: rows without a basket id belong to no basket; null and empty texts have no items;
repeated items in a basket count once; an empty table gives an empty result; a dictionary of 2**31
items or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.functions.runtime import cut
from lakeloom.llm import dictionary as D

#: Items in a segment of a basket, neighbours in one range of a stripe, pairs expanded at once, and
#: distinct pairs held by a task: sizes of work units, none changes the result.
SEGMENT, RANGE, EXPAND, HELD = 2048, 4096, 2_000_000, 3_000_000


def _sum_by(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[at], (np.add.reduceat(n, at) if len(at) else n)


def pair_codes(items: np.ndarray, sizes: np.ndarray, expand: int) -> Iterator[np.ndarray]:
    """item << 32 | later item of the same basket, for sorted baskets of the given sizes end to end. At
    most about expand pairs at once."""
    last = np.repeat(np.cumsum(sizes), sizes)
    positions = np.arange(len(items))
    later = last - positions - 1
    total = np.cumsum(later)
    at = 0
    while at < len(positions):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + expand, side="right")))
        p, k = positions[at:to], later[at:to]
        starts = np.cumsum(k) - k
        second = np.arange(k.sum()) - np.repeat(starts, k) + np.repeat(p + 1, k)
        yield (np.repeat(items[p], k) << 32) | items[second]
        at = to


def crossed_codes(left: np.ndarray, right: np.ndarray, expand: int) -> Iterator[np.ndarray]:
    """item << 32 | other item for every item of left with every one of right, all of which are later."""
    step = max(1, expand // max(len(right), 1))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        yield (np.repeat(part, len(right)) << 32) | np.tile(right, len(part))


def _coded(held, separator: str, most: int):
    """(basket, text) to (basket, ids): the items of each basket of a task, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = D.Encoder(held)
        keys: list[pa.Array] = []
        codes: list[np.ndarray] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            chunked = pa.chunked_array(keys).combine_chunks()
            own = (chunked if isinstance(chunked, pa.Array) else chunked.chunk(0)).dictionary_encode()
            basket = own.indices.to_numpy().astype(np.int64)
            code = np.unique(np.concatenate([(basket[c >> 32] << 32) | (c & 0xFFFFFFFF) for c in codes]))
            size = np.bincount(code >> 32, minlength=len(own.dictionary))
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array((code & 0xFFFFFFFF).astype(np.int32)))
            for at in range(0, len(ids), 10_000):
                yield pa.RecordBatch.from_arrays([own.dictionary.slice(at, 10_000), ids.slice(at, 10_000)], ["basket", "ids"])

        for batch in batches:
            words, row = D.words_of(batch.column(1), separator)
            keys.append(batch.column(0))
            codes.append(((row + rows) << 32) | encoder.ids(words))
            rows += len(batch)
            if sum(map(len, codes)) > most:
                yield from out()
                keys, codes, rows = [], [], 0
        if rows:
            yield from out()

    return run


def _baskets(segment: int):
    """(basket, ids) sorted by basket to its segments (basket, seg, segs, ids): sorted, each item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.Scalar | None = None
        held: list[np.ndarray] = []
        size = 0

        def done(baskets: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            segs = np.maximum(-(-sizes // segment), 1)
            at = np.repeat(np.arange(len(sizes)), segs)
            seg = np.arange(len(at)) - np.repeat(np.cumsum(segs) - segs, segs)
            starts = np.repeat(np.cumsum(sizes) - sizes, segs) + seg * segment
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays([baskets.take(pa.array(at)), pa.array(seg, pa.int32()), pa.array(segs[at], pa.int32()), lists], ["basket", "seg", "segs", "ids"])

        def last() -> pa.RecordBatch:
            ids = np.unique(np.concatenate(held))
            return done(pa.array([key.as_py()], key.type), np.array([len(ids)]), ids)

        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            if not len(batch):
                continue
            counts, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64)
            new = np.r_[key is None or keys[0] != key, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)]
            group = np.cumsum(new) - 1  # -1 for rows of the basket that's still open
            of = np.repeat(group, counts)
            held.append(ids[of == -1])
            size += len(held[-1])
            if size > 1_000_000:  # a basket of very many rows
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
            if group[-1] >= 0:
                if key is not None:
                    yield last()
                code = np.unique((of[of >= 0] << 32) | ids[of >= 0])
                whole = code[(code >> 32) < group[-1]]
                if group[-1]:
                    yield done(keys.filter(pa.array(new)).slice(0, int(group[-1])), np.bincount(whole >> 32, minlength=int(group[-1])), whole & 0xFFFFFFFF)
                key, held = keys[len(keys) - 1], [code[(code >> 32) == group[-1]] & 0xFFFFFFFF]
                size = len(held[0])
        if key is not None:
            yield last()

    return run


def _item_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to count arrays of items; the number of baskets under the id -1."""
    baskets, ids, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        baskets += int((batch.column(1).to_numpy() == 0).sum())
        fresh = batch.column(3).flatten().to_numpy().astype(np.int64)
        ids, counts = _sum_by(np.r_[ids, fresh], np.r_[counts, np.ones(len(fresh), np.int64)])
        if len(ids) > HELD:
            yield D.ranged(ids, counts, np.zeros(len(ids)))
            ids, counts = ids[:0], counts[:0]
    yield D.ranged(ids, counts, np.zeros(len(ids)))
    yield D.ranged(np.array([-1]), np.array([baskets]), np.zeros(1))


def _stripes(expand: int, most: int, counts=None):
    """Segments (ids, others or null) to stripes (item, piece, neighbours, counts); counts: only items
    that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, held = [], [], 0
        keep = None if counts is None else counts.value > 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _sum_by(np.concatenate(codes), np.concatenate(numbers)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def emit(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = code >> 32 << 32 | ((code & 0xFFFFFFFF) // RANGE)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            for at in range(0, len(starts), 20_000):
                own = starts[at : at + 20_000]
                end = starts[at + 20_000] if at + 20_000 < len(starts) else len(code)
                lists = pa.array(np.r_[own, end] - own[0], pa.int32())
                part = slice(own[0], end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((code[own] >> 32).astype(np.int32)), pa.array((key[own] & 0xFFFFFFFF).astype(np.int32)), pa.ListArray.from_arrays(lists, pa.array(((code[part] & 0xFFFFFFFF) % RANGE).astype(np.int16))), pa.ListArray.from_arrays(lists, pa.array(n[part].astype(np.int32)))],
                    ["item", "piece", "neighbours", "counts"],
                )

        def parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            lists, others = batch.column(0), batch.column(1)
            alone = pc.is_null(others).to_numpy(zero_copy_only=False)
            ids, size = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
            used = np.repeat(alone, size)
            if keep is not None:
                used &= keep[ids]
            row = np.repeat(np.arange(len(batch)), size)
            yield from pair_codes(ids[used], np.bincount(row[used], minlength=len(batch)), expand)
            for k in np.flatnonzero(~alone):
                a, b = (np.asarray(c[int(k)].values, np.int64) for c in (lists, others))
                if keep is not None:
                    a, b = a[keep[a]], b[keep[b]]
                yield from crossed_codes(a, b, expand)

        for batch in batches:
            for code in parts(batch):
                code, n = np.unique(code, return_counts=True)
                codes.append(code)
                numbers.append(n.astype(np.int64))
                held += len(code)
                if held > 2 * most:
                    code, n = merged()
                    codes, numbers, held = [code], [n], len(code)
                    if held > most:
                        yield from emit(code, n)
                        codes, numbers, held = [], [], 0
        yield from emit(*merged())

    return run


def _merge(least: int, counts=None, lift: float = 0.0):
    """Merge stripes sorted by (item, range) into pair counts of at least least; with the items' counts at
    hand also only of about the lift (times baskets) at least, the exact test comes later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keep = n >= least
            if counts is not None:
                both = counts.value[code >> 32].astype(float) * counts.value[code & 0xFFFFFFFF]
                keep &= n >= lift * both * (1 - 1e-9)
            return pa.RecordBatch.from_arrays([pa.array(code[keep] >> 32), pa.array(code[keep] & 0xFFFFFFFF), pa.array(n[keep])], ["a", "b", "n_ab"])

        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            item, piece = (np.repeat(batch.column(k).to_numpy().astype(np.int64), size) for k in (0, 1))
            fresh = (item << 32) | (piece * RANGE + batch.column(2).flatten().to_numpy())
            code, n = _sum_by(np.r_[code, fresh], np.r_[n, batch.column(3).flatten().to_numpy()])
            if len(code):
                key = code >> 32 << 32 | ((code & 0xFFFFFFFF) // RANGE)
                done = int(np.searchsorted(key, key[-1]))  # the last stripe may go on in the next batch
                yield out(code[:done], n[:done])
                code, n = code[done:], n[done:]
        yield out(code, n)

    return run


def basket_items(rows: DataFrame, basket: str, text: str, words: D.Dictionary, separator: str = " ") -> DataFrame:
    """(basket, seg, segs, ids): the distinct items of every basket in segments of at most SEGMENT."""
    texts = rows.where(F.col(basket).isNotNull() & F.col(text).isNotNull()).select(F.col(basket).alias("basket"), F.col(text).alias("text"))
    key = texts.schema["basket"].dataType.simpleString()
    if words.held is not None:
        coded = texts.mapInArrow(_coded(words.held, separator, HELD), f"basket {key}, ids array<int>")
    else:
        items = texts.select("basket", F.explode(F.split("text", separator)).alias("term")).where("term <> ''").distinct()
        coded = items.join(words.entries, "term").select("basket", F.array(F.col("id").cast("int")).alias("ids"))
    return _segmented(coded.where(F.size("ids") > 0), key)


def _segmented(coded: DataFrame, key: str) -> DataFrame:
    placed = coded.repartition(F.col("basket")).sortWithinPartitions("basket")
    return cut(placed.mapInArrow(_baskets(SEGMENT), f"basket {key}, seg int, segs int, ids array<int>"))


def co_occurring(rows: DataFrame, basket: str, text: str, min_count: int = 5, min_lift: int = 8, separator: str = " ") -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of every pair of items that at least min_count
    baskets have together and that is together min_lift times as often as chance would have it."""
    words = D.build(rows.where(F.col(basket).isNotNull()), text, separator)
    if words.size >= 2**31:
        raise OverflowError(f"{words.size} items")
    baskets = basket_items(rows, basket, text, words, separator)
    counted = cut(D.sum_arrays(baskets.mapInArrow(_item_arrays, D.ARRAYS)))
    total = counted.where("id = -1").agg(F.sum("first")).first()[0] or 0  # one number
    kept = counted.where((F.col("id") >= 0) & (F.col("first") >= min_count) & (F.col("first").cast("decimal(38,0)") * min_lift <= F.lit(total))).select("id", F.col("first").alias("n_item"))
    counts = None
    if words.held is not None:
        table, own = np.zeros(max(words.size, 1), np.int64), kept.toArrow()  # at most MOST_TERMS rows
        table[own.column("id").to_numpy()] = own.column("n_item").to_numpy()
        counts = rows.sparkSession.sparkContext.broadcast(table)
    else:
        some = baskets.select("basket", F.explode("ids").alias("id")).join(kept.select("id"), "id").select("basket", F.array(F.col("id").cast("int")).alias("ids"))
        baskets = _segmented(some, baskets.schema["basket"].dataType.simpleString())
    none = F.lit(None).cast("array<int>")
    left = baskets.where("segs > 1").select("basket", F.col("seg").alias("s"), "ids")
    right = baskets.where("segs > 1").select(F.col("basket").alias("__b"), F.col("seg").alias("__s"), F.col("ids").alias("others"))
    met = left.join(right, (F.col("basket") == F.col("__b")) & (F.col("s") < F.col("__s"))).select("ids", "others")
    work = baskets.select("ids", none.alias("others")).unionByName(met.repartition(F.xxhash64("ids", "others")))
    stripes = work.mapInArrow(_stripes(EXPAND, HELD, counts), "item int, piece int, neighbours array<smallint>, counts array<int>")
    pairs = stripes.repartition(F.col("item"), F.col("piece")).sortWithinPartitions("item", "piece").mapInArrow(_merge(min_count, counts, min_lift / max(total, 1)), "a long, b long, n_ab long")
    items = cut(kept.join(words.entries, "id").select("id", F.col("term").alias("item"), "n_item"))
    side = lambda s, k: items.select(F.col("id").alias(k), F.col("item").alias(f"item_{s}"), F.col("n_item").alias(f"n_{s}"))
    named = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").withColumn("n", F.lit(total).cast("long"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    enough = named.where(big("n_ab") * big("n") >= big("n_a") * big("n_b") * F.lit(min_lift))
    lift = F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
    return enough.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), _llr().alias("llr"))


def _llr():
    """Dunning's log-likelihood ratio of the 2 x 2 table of a pair."""
    k11, k12, k21 = F.col("n_ab").cast("double"), (F.col("n_a") - F.col("n_ab")).cast("double"), (F.col("n_b") - F.col("n_ab")).cast("double")
    k22 = F.col("n").cast("double") - k11 - k12 - k21
    h = lambda *ks: sum((F.when(k > 0, k * F.log(k)).otherwise(0.0) for k in ks), F.lit(0.0))
    n = F.col("n").cast("double")
    return 2 * (h(k11, k12, k21, k22) + h(n) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = co_occurring(spark.read.parquet(f"{d}/members.parquet"), "post_id", "tags")
    return pairs.withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("tag_a", "tag_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


_PAIRS = r"""
WITH e AS (SELECT DISTINCT post_id, tag FROM (SELECT post_id, unnest(string_split(tags, ' ')) AS tag FROM members WHERE post_id IS NOT NULL) WHERE tag <> ''),
n AS (SELECT count(DISTINCT post_id) AS n FROM e),
c AS (SELECT tag, count(*) AS k FROM e GROUP BY tag),
u AS (SELECT e.* FROM e JOIN c USING (tag), n WHERE k >= 5 AND k * 8 <= n),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM u x JOIN u y ON x.post_id = y.post_id AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 5),
q AS (SELECT tag_a, tag_b, n_ab, a.k AS n_a, b.k AS n_b, n FROM p JOIN c a ON a.tag = tag_a JOIN c b ON b.tag = tag_b, n WHERE n_ab * n >= 8 * a.k * b.k),
k AS (SELECT *, n_ab::DOUBLE AS k11, (n_a - n_ab)::DOUBLE AS k12, (n_b - n_ab)::DOUBLE AS k21, (n - n_a - n_b + n_ab)::DOUBLE AS k22 FROM q)
SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab * n::DOUBLE / (n_a::DOUBLE * n_b), 6) AS lift,
round(2 * (k11 * ln(k11) + CASE WHEN k12 > 0 THEN k12 * ln(k12) ELSE 0 END + CASE WHEN k21 > 0 THEN k21 * ln(k21) ELSE 0 END + CASE WHEN k22 > 0 THEN k22 * ln(k22) ELSE 0 END
 + n * ln(n) - n_a * ln(n_a) - (n - n_a) * ln(n - n_a) - n_b * ln(n_b) - (n - n_b) * ln(n - n_b)), 4) AS llr FROM k
"""
SQL = {"p5_pairs": _PAIRS, "p5_found": f"SELECT tag_a, tag_b FROM ({_PAIRS})"}
QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
