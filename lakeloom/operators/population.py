"""The two population rankings, end to end: features, scores, ranks, selection, summaries, validation.

rows: asset (text, unique), rating, created, observed (timestamps), fav, up, down (whole numbers or null),
maker (or null), hints (bit mask). Everything is computed per rating; ranks and percentiles are made by
range over all tasks, small tables (one row per rating, period or window) are joined back."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.functions.runtime import stored
from lakeloom.functions.stats import bucket, clamp, midranks, running_totals, shrunk
from lakeloom.functions.windows import window_medians
from lakeloom.operators import ranking as R
from lakeloom.plans.paging import positions


@dataclass(frozen=True)
class Settings:
    """Parameters of both rankings; the defaults are fixed values."""

    seed: str = "seed-1"
    quotas: tuple[int, int, int] = (280, 43, 10)
    least: int = 5000
    time: bool = True
    makers: bool = False
    votes: bool = True
    time_weight: float = 0.30
    maker_weight: float = 0.25
    vote_weight: float = 0.08
    # of the second ranking
    feather_days: int = 90
    least_effective: float = 5000.0
    time_down: float = 0.0
    era_weight: float = 0.30
    penalty: float = 0.0
    keep: int = 333
    rescue: tuple[int, int] = (50, 50)
    audit: int = 30
    eras: tuple[tuple[int, int, float, int | None], ...] = field(default=())  # (first year, last year, bonus, share or None)


def known(c: str) -> Column:
    """A count, or null for a negative one."""
    return F.when(F.col(c) >= 0, F.col(c))


def features(rows: DataFrame, p: Settings, weight: str | None = None) -> DataFrame:
    """rows with heat, support, g, v, level, cohort_n, k, c and a (see the module's docstring). weight: the
    column of how often each row counts (not with makers)."""
    if p.makers and weight:
        raise ValueError("weight")
    times = F.lit(1) if weight is None else F.col(weight)
    created, observed = F.unix_micros("created"), F.unix_micros("observed")
    low, high = R.age(created, observed, F.lit(False))
    x = stored(rows.withColumns({"heat": R.heat(F.col("fav"), F.col("up")), "age_low": low, "age_high": high, "support": F.greatest(F.coalesce(known("fav"), F.lit(0)), F.coalesce(known("up"), F.lit(0)))}))
    both = known("up").isNotNull() & F.col("down").isNotNull()
    sizes = x.groupBy("rating").agg(
        F.coalesce(F.sum(F.when(F.col("heat").isNotNull(), times)), F.lit(0)).alias("valid"),
        (F.sum(F.when(both, F.abs("down") * times)) / F.nullif(F.sum(F.when(both, (F.col("up") + F.abs("down")) * times)), F.lit(0))).alias("q0"),
    ).withColumnRenamed("rating", "__r")
    x = midranks(x, ["rating"], "heat", weight, "g").withColumn("g", F.coalesce("g", F.lit(0.5)))
    x = x.join(sizes, F.col("rating").eqNullSafe(F.col("__r"))).drop("__r")
    vote = R.vote_penalty(F.col("up"), F.abs("down"), F.coalesce("q0", F.lit(0.0)))
    x = x.withColumn("v", F.when(both, vote).otherwise(0.0) if p.votes else F.lit(0.0))
    x = stored(x)
    x = _cohorts(x, p, weight) if p.time else x.withColumns({"level": F.lit(None).cast("int"), "cohort_n": F.lit(None).cast("long"), "k": F.lit(None).cast("double"), "c": F.col("g")})
    return _maker_priors(stored(x), p) if p.makers else x.withColumn("a", F.lit(0.0))


def _cohorts(x: DataFrame, p: Settings, weight: str | None = None) -> DataFrame:
    """The first level of the ladder that has enough rows, its percentile and the median of support there."""
    x = stored(R.cohort_percentiles(x, ["rating"], "created", "age_low", "age_high", "heat", p.least, weight=weight))
    x = x.withColumns({c: F.when(F.col("valid") >= p.least, F.col(c)) for c in ("level", "cohort_n", "local")})
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    months = F.element_at(F.array(*[F.lit(m) for m, _ in R.LADDER]), F.col("level") + 1)
    step = F.make_interval(F.lit(0), months)
    kinds = list(dict.fromkeys(tuple(e) for _, e in R.LADDER))
    of = lambda e: bucket(F.col("age_low"), F.col("age_high"), [d * R.DAY for d in e])
    which = F.element_at(F.array(*[F.lit(kinds.index(tuple(e))) for _, e in R.LADDER]), F.col("level") + 1)
    age = F.coalesce(*[F.when(which == i, of(e)) for i, e in enumerate(kinds)])
    asked = x.withColumns({"__set": which, "__age": age, "__lo": day(F.col("created") - step), "__hi": day(F.col("created") + step)})
    own = [weight] if weight else []
    points = x.where("heat IS NOT NULL AND created IS NOT NULL").select("rating", day(F.col("created")).alias("t"), "support", *own, F.explode(F.array(*[F.struct(F.lit(i).alias("__set"), of(e).alias("__age")) for i, e in enumerate(kinds)])).alias("b"))
    points = points.select("rating", "t", "support", *own, "b.*").where("__age IS NOT NULL")
    y = window_medians(asked.withColumnsRenamed({"__lo": "w_lo", "__hi": "w_hi"}), ["rating", "__set", "__age"], "w_lo", "w_hi", points, "t", "support", weight=weight).drop("w_lo", "w_hi", "__set", "__age")
    k = F.when(F.col("level").isNotNull(), F.coalesce(clamp(F.col("median") / 4, 1.0, 10.0), F.lit(1.0)))
    y = y.withColumn("k", k).drop("median")
    return y.withColumn("c", F.when(F.col("level").isNotNull(), shrunk(F.col("local"), F.col("cohort_n"), F.col("support").cast("double"), F.col("k"))).otherwise(F.col("g"))).drop("local")


def _maker_priors(x: DataFrame, p: Settings) -> DataFrame:
    mean = x.groupBy(F.col("rating").alias("__r")).agg(F.avg("c").alias("__mu"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    lo, hi = R.months_window(F.col("created"), 36)
    x = x.join(mean, F.col("rating").eqNullSafe(F.col("__r"))).withColumns({"m_t": day(F.col("created")), "m_lo": day(lo), "m_hi": day(hi)})
    x = R.maker_prior(x, ["rating", "maker"], "m_t", "m_lo", "m_hi", "c", F.col("__mu"))
    return x.withColumnRenamed("prior", "a").drop("__r", "__mu", "m_t", "m_lo", "m_hi")


def ranked(rows: DataFrame, score: str, name: str, ties: list[Column], group: list[str] | None = None) -> DataFrame:
    """(__asset, name): the place by a score within the rating (or another group), from 1, ties by the given
    columns and the asset. Only what the order needs is sorted."""
    group = group or ["rating"]
    keys = {f"__tie{k}": c for k, c in enumerate(ties)}
    narrow = rows.select("asset", *group, score, *[c.alias(k) for k, c in keys.items()])
    placed = positions(narrow, [F.col(score).desc(), *map(F.col, keys), F.col("asset")], group)
    return placed.select(F.col("asset").alias("__asset"), F.col("position").alias(name))


def with_ranks(rows: DataFrame, ranks: list[DataFrame]) -> DataFrame:
    """rows with the columns of tables by __asset."""
    for r in ranks:
        rows = rows.join(r, F.col("asset") == F.col("__asset")).drop("__asset")
    return rows


def rank_first(rows: DataFrame, p: Settings, select: bool = True) -> DataFrame:
    """The first ranking: main and rescue scores and ranks, and with select the routes."""
    x = features(rows, p)
    G, C, A, V = (F.col(n) for n in "gcav")
    x = stored(x.withColumns({
        "main_score": F.round(100 * clamp(G + p.time_weight * F.greatest(C - G, F.lit(0.0)) - p.vote_weight * V, 0.0, 1.0), 9),
        "rescue_score": F.round(100 * clamp(C + p.maker_weight * A * (1 - C) - p.vote_weight * V, 0.0, 1.0), 9),
    }))
    tie = R.tie_key("score-tie", p.seed, F.col("asset"))
    x = stored(with_ranks(x, [ranked(x, f"{name}_score", f"{name}_rank", [tie]) for name in ("main", "rescue")]))
    if not select:
        return x.withColumns({"tie": tie, "route": F.lit("ranked")})
    order = x.withColumns({"__main": -F.col("main_rank"), "__rescue": -F.col("rescue_rank")})
    x = R.routes(order, "rating", "__main", "__rescue", R.tie_key("audit", p.seed, F.col("asset")), "asset", list(p.quotas))
    return stored(x.drop("__main", "__rescue")).withColumn("tie", tie)


def summary(ranked_rows: DataFrame, p: Settings) -> DataFrame:
    """One row per rating: counts, levels used, selected by route, and how many of the selected the same
    number of rows with the most favourites would have had."""
    chosen = F.col("route").isin("main", "rescue", "audit")
    x = ranked_rows.withColumn("__fav", F.coalesce("fav", F.lit(-1)))
    by_fav = positions(x, [F.col("__fav").desc(), F.col("asset")], ["rating"])
    sizes = x.groupBy(F.col("rating").alias("__r")).agg(F.count_if(chosen).alias("budget"))
    return by_fav.join(sizes, F.col("rating").eqNullSafe(F.col("__r"))).groupBy("rating").agg(
        F.count("*").alias("eligible"), F.count("heat").alias("valid_heat"), *[F.count_if(F.col("level") == i).alias(f"level_{i}") for i in range(len(R.LADDER))],
        F.count_if(F.col("level").isNull()).alias("fallback"), F.count_if(F.col("a") > 0).alias("maker_used"),
        *[F.count_if(F.col("route") == r).alias(r) for r in ("main", "rescue", "audit")], F.count_if(chosen & (F.col("position") <= F.col("budget"))).alias("baseline_overlap"),
    )


# --- the second ranking ----------------------------------------------------------------------------


def _periods(x: DataFrame, p: Settings, weight: str | None = None) -> DataFrame:
    """x with old and new percentiles in the periods around a new year, and which of them there are."""
    x = stored(x)
    year = F.year("created")
    start = lambda y: F.unix_micros(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    left, right, w = R.feather(F.unix_micros("created"), start(year), start(year + 1), p.feather_days)
    x = x.withColumns({"created_year": year, "old_period": year + left, "new_period": year + right, "w": w, "age": bucket(F.col("age_low"), F.col("age_high"), [d * R.DAY for d in R.BROAD])})
    parts = F.array(F.struct(F.lit("old").alias("side"), F.col("old_period").alias("period"), (1 - F.col("w")).alias("weight")), F.struct(F.lit("new").alias("side"), F.col("new_period").alias("period"), F.col("w").alias("weight")))
    m = x.where("heat IS NOT NULL AND age IS NOT NULL AND created IS NOT NULL").select("asset", "rating", "heat", "support", "age", (F.lit(1) if weight is None else F.col(weight)).alias("times"), F.explode(parts).alias("m")).select("*", "m.*").drop("m").where("weight > 0")
    m = stored(m.withColumn("mass", F.col("weight") * F.col("times")))
    key = ["rating", "period", "age"]
    sizes = m.groupBy(*key).agg((F.sum("mass") ** 2 / F.sum(F.col("weight") ** 2 * F.col("times"))).alias("effective")).where(F.col("effective") >= p.least_effective)
    ties = m.where("support > 0").groupBy(*key, "support").agg(F.sum("mass").alias("weight"))
    half = running_totals(ties, key, [F.col("support").asc()], "weight").where(F.col("before") + F.col("weight") >= F.col("total") / 2)
    median = half.groupBy(*key).agg(F.min("support").alias("median"))
    k = F.coalesce(clamp(F.col("median") / 4, 1.0, 10.0), F.lit(1.0))
    placed = midranks(m, key, "heat", "mass", "raw").join(sizes.join(median, key, "left").select(*key, "effective", k.alias("k2")), key)
    placed = placed.select("asset", "side", shrunk(F.col("raw"), F.col("effective"), F.col("support").cast("double"), F.col("k2")).alias("pct"))
    sides = placed.groupBy(F.col("asset").alias("__a")).agg(*[F.max(F.when(F.col("side") == s, F.col("pct"))).alias(f"{s}_percentile") for s in ("old", "new")])
    return x.join(sides, F.col("asset") == F.col("__a"), "left").drop("__a", "age")


def scores_second(x: DataFrame, p: Settings) -> DataFrame:
    """What _periods gives, with direct and era scores and the bonus; nothing here depends on hints."""
    G, C, V, W = (F.col(n) for n in ("g", "c", "v", "w"))
    Y = (1 - W) * F.coalesce("old_percentile", "c") + W * F.coalesce("new_percentile", "c")
    bonus = lambda y: F.coalesce(*[F.when(F.col(y).between(a, b), F.lit(x)) for a, b, x, _ in p.eras], F.lit(0.0))
    x = x.withColumns({
        "era_fallback": F.coalesce((F.col("old_percentile").isNull() & (W < 1)) | (F.col("new_percentile").isNull() & (W > 0)), F.lit(True)),
        "year_percentile": F.coalesce(Y, C),
        "direct_raw": F.round(G + p.time_weight * F.greatest(C - G, F.lit(0.0)) - p.time_down * F.greatest(G - C, F.lit(0.0)) - p.vote_weight * V, 12),
        "era_bonus": F.coalesce((1 - W) * bonus("old_period") + W * bonus("new_period"), F.lit(0.0)),
    })
    return x.withColumn("era_raw", F.round(F.col("year_percentile") + p.maker_weight * F.col("a") * (1 - F.col("year_percentile")) - p.vote_weight * V, 12))


def by_hints(p: Settings) -> dict[str, Column]:
    """Whether a row's hints protect it, and the penalty they give."""
    protected = F.col("hints").bitwiseAND(28) != 0
    return {"protected": protected, "type_penalty": F.when((F.col("hints").bitwiseAND(2) != 0) & ~protected, p.penalty).otherwise(0.0)}


def fused(n: DataFrame, p: Settings, weight: str | None = None) -> DataFrame:
    """Rows of rating, direct_raw and era_raw with both percentiles and fused_score."""
    share = p.era_weight if p.time else 0.0
    n = midranks(midranks(n, ["rating"], "direct_raw", weight, "direct_percentile"), ["rating"], "era_raw", weight, "era_percentile")
    return n.withColumn("fused_score", F.round(100 * ((1 - share) * F.col("direct_percentile") + share * F.col("era_percentile")), 9))


def main_score() -> Column:
    return F.round(F.col("fused_score") - F.col("type_penalty") + F.col("era_bonus"), 9)


def rank_second(rows: DataFrame, p: Settings, select: bool = True) -> DataFrame:
    """The second ranking: direct, era and fused scores and ranks, and with select a selection by year
    targets with exclusive rescue and audit."""
    x = stored(scores_second(_periods(features(rows, p), p), p).withColumns(by_hints(p)))
    n = fused(x.select("asset", "rating", "direct_raw", "era_raw", "type_penalty", "era_bonus"), p)
    n = stored(n.withColumn("main_score", main_score()).drop("direct_raw", "era_raw", "type_penalty", "era_bonus"))
    ranks = [ranked(rows_, score, name, [], group) for rows_, score, name, group in (
        (x, "direct_raw", "direct_rank", ["rating"]), (x, "era_raw", "rescue_rank", ["rating"]), (n, "main_score", "main_rank", ["rating"]), (x, "era_raw", "year_rank", ["rating", "created_year"]),
    )]
    placed = stored(with_ranks(n.drop("rating"), ranks)).withColumnRenamed("asset", "__asset")
    x = with_ranks(x, [placed])
    return select_second(x, p) if select else x.withColumn("route", F.lit("ranked"))


#: What the features and scores of the second ranking depend on, without makers.
PROFILE = ["rating", "created", "observed", "fav", "up", "down"]


def scored_second(rows: DataFrame, p: Settings) -> DataFrame:
    """The second ranking's scores of each row, without ranks and wide columns: features are computed once
    for all rows that are alike in PROFILE, and counted as often as there are such rows."""
    rows = stored(rows.select("asset", *PROFILE, "hints"))
    alike = stored(rows.groupBy(*PROFILE).agg(F.count("*").alias("times")).withColumn("asset", F.monotonically_increasing_id()))
    x = stored(scores_second(_periods(features(alike, p, "times"), p, "times"), p))
    n = fused(x.select("asset", "rating", "direct_raw", "era_raw", "times"), p, "times").select(F.col("asset").alias("__asset"), "fused_score")
    x = with_ranks(x, [n]).select(*[F.col(c).alias(f"__{c}") for c in PROFILE], "created_year", "era_fallback", "direct_raw", "era_raw", "era_bonus", "fused_score")
    out = rows.join(x, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in PROFILE])).withColumns(by_hints(p)).withColumn("main_score", main_score())
    return stored(out.select("asset", "rating", "created_year", "era_fallback", "protected", "type_penalty", "direct_raw", "era_raw", "main_score"))


def targets(budget: int, rates: list[int], available: list[int]) -> tuple[list[int], int]:
    """(capacity of each era, free slots): whole shares of the budget, what an era can't fill is free."""
    exact = [budget * r for r in rates]
    out = [e // 1000 for e in exact]
    for i in sorted(range(len(rates)), key=lambda i: (-(exact[i] % 1000), i))[: budget - sum(out)]:
        out[i] += 1
    return [min(a, b) for a, b in zip(out, available)], sum(max(a - b, 0) for a, b in zip(out, available))


#: Parts of an order that rows are counted in, and the ends of a first part of no rows and of all.
SLOTS, NONE, ALL = 4096, (0,), (2,)


@dataclass(frozen=True)
class Line:
    """An order of rows, by a key (falling if down) and the asset; slot cuts it into SLOTS parts.

    The first rows of a group are all those up to an end, (1, key, asset), which is found without numbering
    the rows: the counts of the slots tell in which one it lies, and only that slot's rows are sorted."""

    key: Column
    down: bool
    slot: Column

    def until(self, names: list[str], ends: dict[tuple, tuple]) -> Column:
        """Whether a row is at or before the end of its group."""
        out = []
        for g, end in ends.items():
            yes = F.lit(end == ALL)
            if end not in (NONE, ALL):
                key, asset = F.lit(end[1]), F.lit(end[2])
                yes = (self.key > key if self.down else self.key < key) | ((self.key == key) & (F.col("asset") <= asset))
            out.append(F.when(same_group(names, g), yes))
        return F.coalesce(*out, F.lit(False))

    def place(self, end: tuple) -> tuple:
        """end as a tuple that Python orders as the rows are (keys that fall are numbers)."""
        return (1, -end[1] if self.down else end[1], end[2]) if len(end) > 1 else end

    def counts(self, rows: DataFrame, names: list[str]) -> dict[tuple, np.ndarray]:
        """Rows in each slot by group; at most SLOTS numbers a group come to the driver."""
        out: dict[tuple, np.ndarray] = {}
        for *g, slot, n in rows.groupBy(*names, self.slot.alias("__slot")).count().collect():
            out.setdefault(tuple(g), np.zeros(SLOTS, np.int64))[slot] = n
        return out

    def ends(self, rows: DataFrame, names: list[str], found: dict[tuple, tuple]) -> dict[tuple, tuple]:
        """The ends of groups' first rows, of found: NONE, ALL, or a slot and the place (from 1) in it."""
        open_ = {g: x for g, x in found.items() if x not in (NONE, ALL)}
        if not open_:
            return found
        within = lambda c, k: F.coalesce(*[F.when(same_group(names, g), c == x[k]) for g, x in open_.items()], F.lit(False))
        few = rows.where(within(self.slot, 1)).select("asset", *names, self.key.alias("__key"))
        key = F.col("__key")
        placed = positions(few, [key.desc() if self.down else key.asc(), F.col("asset")], names)
        hits = placed.where(within(F.col("position"), 2)).select(*names, "__key", "asset").collect()  # one row for each group
        return found | {tuple(g): (1, key, asset) for *g, key, asset in hits}

    def first(self, rows: DataFrame, names: list[str], wanted: dict[tuple, int]) -> Column:
        """Whether a row is of the first wanted of its group."""
        counts = self.counts(rows, names)
        return self.until(names, self.ends(rows, names, {g: nth(counts[g], k) for g, k in wanted.items() if g in counts}))


def same_group(names: list[str], group: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(names, group)])


def nth(counts: np.ndarray, k: int) -> tuple:
    """Where the first k rows end: NONE, ALL, or (1, slot, place in it)."""
    if k <= 0 or k >= counts.sum():
        return NONE if k <= 0 else ALL
    upto = np.cumsum(counts)
    slot = int(np.searchsorted(upto, k))
    return 1, slot, int(k - upto[slot] + counts[slot])


def head(counts: np.ndarray, at: tuple) -> np.ndarray:
    """The part of counts up to where nth says."""
    if at in (NONE, ALL):
        return counts * (at == ALL)
    out = np.where(np.arange(SLOTS) < at[1], counts, 0)
    out[at[1]] = at[2]
    return out


def lines(rows: DataFrame, keys: dict[str, bool]) -> list[Line]:
    """An order by each of the columns (falling or not), in slots of equal width between least and most."""
    ends = rows.agg(*[f(c) for c in keys for f in (F.min, F.max)]).first()  # two numbers each
    out = []
    for k, (c, down) in enumerate(keys.items()):
        lo, hi = (0.0 if x is None else float(x) for x in ends[2 * k : 2 * k + 2])
        away = F.lit(hi) - F.col(c) if down else F.col(c) - F.lit(lo)
        out.append(Line(F.col(c), down, F.least(F.floor(away / (hi - lo) * SLOTS), F.lit(SLOTS - 1)).cast("int") if hi > lo else F.lit(0)))
    return out


def admit(rows: DataFrame, line: Line, wanted: dict, room: dict, free: dict) -> tuple[Column, Column]:
    """Whether a row is admitted, and whether it takes a slot of its era: in the order, per rating, each row
    takes a slot of its era or, if those are gone, a free one; at most wanted rows. room: slots by (rating,
    era), free and wanted by rating.

    Done by ends, not one by one: rows up to their era's end have its slots, of the others those up to the
    free slots' end have these, and of all these the ones up to the wanted number's end count."""
    both, counts = ["rating", "era"], line.counts(rows, ["rating", "era"])
    counts = {g: n for g, n in counts.items() if g[0] in wanted}
    at = {g: nth(n, room.get(g, 0)) for g, n in counts.items()}
    own = line.ends(rows, both, at)
    total = lambda parts: {(r,): sum(n for g, n in parts.items() if g[0] == r) for r in {g[0] for g in parts}}
    kept = {g: head(n, at[g]) for g, n in counts.items()}
    over = total({g: n - kept[g] for g, n in counts.items()})
    at = {r: nth(n, free[r[0]]) if n.sum() else NONE for r, n in over.items()}
    spare = line.ends(rows.where(~line.until(both, own)), ["rating"], at)
    can = {r: n + head(over[r], at[r]) for r, n in total(kept).items()}
    reach = {g: max(end, spare[g[:1]], key=line.place) for g, end in own.items()}
    most = line.ends(rows.where(line.until(both, reach)), ["rating"], {r: nth(n, wanted[r[0]]) for r, n in can.items()})
    return line.until(both, {g: min(end, most[g[:1]], key=line.place) for g, end in reach.items()}), line.until(both, own)


def selected(rows: DataFrame, p: Settings, sizes: dict[tuple, int], by: list[Line], direct: Column, late: Column) -> Column:
    """The route of rows with era: first rows that only the direct or only the late order would select, in
    these orders, then by the main order, then by a hash. by: the three orders; sizes by (rating, era)."""
    aimed = [e[3] for e in p.eras if e[3] is not None]
    rates = [*aimed, 1000 - sum(aimed)]
    budget, room, free = budgets(sizes, p), {}, {}
    for r in budget:
        own, free[r] = targets(budget[r], rates, [sizes.get((r, e), 0) for e in range(len(rates))])
        room |= {(r, e): n for e, n in enumerate(own)}
    tie = R.tie_key("audit", p.seed, F.col("asset"))
    audit = Line(tie, False, F.conv(F.substring(tie, 1, 3), 16, 10).cast("int"))
    picked, audits = dict.fromkeys(budget, 0), {r: n * p.audit // 1000 for r, n in budget.items()}
    stages = [
        ("rescue", direct & ~late, by[0], lambda r: budget[r] * p.rescue[0] // 1000), ("rescue", late & ~direct, by[1], lambda r: budget[r] * p.rescue[1] // 1000),
        ("main", F.lit(True), by[2], lambda r: max(0, budget[r] - audits[r] - picked[r])), ("audit", F.lit(True), audit, lambda r: budget[r] - picked[r]),
    ]
    routes, gone = [], F.lit(False)
    for route, which, line, wanted in stages:
        left = rows.where(which & ~gone)
        yes, own = admit(left, line, {r: wanted(r) for r in budget}, room, free)
        for r, e, n, on_free in left.where(yes).groupBy("rating", "era").agg(F.count("*"), F.count_if(~own)).collect():
            picked[r] += n
            room[r, e] -= n - on_free
            free[r] -= on_free
        routes.append(F.when(which & yes, route))
        gone = gone | (which & yes)
    return F.coalesce(*routes, F.lit("rejected"))


def budgets(sizes: dict[tuple, int], p: Settings) -> dict:
    """Rows to select by rating, of sizes by (rating, era); none of an unknown rating."""
    return {r: sum(n for (q, _), n in sizes.items() if q == r) * p.keep // 1000 for r in sorted({r for r, _ in sizes if r is not None})}


def with_era(x: DataFrame, p: Settings) -> DataFrame:
    aimed = [e for e in p.eras if e[3] is not None]
    return x.withColumn("era", F.coalesce(*[F.when(F.col("created_year").between(a, b), i) for i, (a, b, _, _) in enumerate(aimed)], F.lit(len(aimed))))


def era_sizes(x: DataFrame) -> dict[tuple, int]:
    return {(r[0], r[1]): r[2] for r in x.groupBy("rating", "era").count().collect()}  # one number per rating and era


def select_second(x: DataFrame, p: Settings) -> DataFrame:
    """x with route and era: the budget's rows within the eras' slots. First rows that only the direct or
    only the era rank would select, then by main rank, then by a hash."""
    x = with_era(x, p)
    narrow = stored(x.select("asset", "rating", "era", "direct_rank", "rescue_rank", "main_rank"))
    sizes = era_sizes(narrow)
    budget = budgets(sizes, p)
    direct, late = (F.coalesce(*[F.when(same_group(["rating"], (r,)), F.col(c) <= n) for r, n in budget.items()], F.lit(False)) for c in ("direct_rank", "rescue_rank"))
    by = lines(narrow, {"direct_rank": False, "rescue_rank": False, "main_rank": False})
    return x.withColumn("route", selected(narrow, p, sizes, by, direct, late))


def years_second(rows: DataFrame, p: Settings) -> DataFrame:
    """years() of the second ranking with its selection, for which no row needs a rank: only the ends of the
    first rows of each order are sought."""
    if p.makers:
        return years(rank_second(rows, p))
    x = with_era(scored_second(rows, p), p)
    sizes = era_sizes(x)
    budget = {(r,): n for r, n in budgets(sizes, p).items()}
    by = lines(x, {"direct_raw": True, "era_raw": True, "main_score": True})
    direct, late = (line.first(x, ["rating"], budget) for line in by[:2])
    best = by[2].first(x, ["rating"], {(r,): -(-sum(n for (q, _), n in sizes.items() if q == r) // 100) for r, _ in sizes})
    return x.withColumn("route", selected(x, p, sizes, by, direct, late)).withColumn("top", best).groupBy("rating", "created_year").agg(*_year_columns(F.col("top")))


def _year_columns(top: Column) -> list[Column]:
    return [
        F.count("*").alias("n"), F.count_if(F.col("route").isin("main", "rescue", "audit")).alias("selected"), F.count_if(top).alias("top"),
        F.count_if("era_fallback").alias("fallback"), F.count_if("protected").alias("protected"), F.count_if(F.col("type_penalty") > 0).alias("penalised"),
    ]


def years(x: DataFrame) -> DataFrame:
    """(rating, created_year): rows, selected, of the best hundredth, fallback, protected, penalised."""
    heads = x.groupBy(F.col("rating").alias("__r")).agg(F.ceil(F.count("*") / 100).alias("__head"))
    return x.join(heads, F.col("rating").eqNullSafe(F.col("__r"))).groupBy("rating", "created_year").agg(*_year_columns(F.col("main_rank") <= F.col("__head")))


def validate(x: DataFrame, ranks: list[str]) -> DataFrame:
    """(rating, check, ok) of a ranking's whole output: every rank column is a permutation of 1..n, and the
    main score falls along the main rank."""
    out = []
    for r in ranks:
        ok = (F.count("*") == F.countDistinct(r)) & (F.min(r) == 1) & (F.max(r) == F.count("*"))
        out.append(x.groupBy("rating").agg(ok.alias("ok")).select("rating", F.lit(r).alias("check"), "ok"))
    step = x.select("rating", "main_rank", "main_score").withColumn("next", F.col("main_rank") + 1)
    pairs = step.join(step.select(F.col("rating").alias("r2"), F.col("main_rank").alias("m2"), F.col("main_score").alias("s2")), (F.col("rating") == F.col("r2")) & (F.col("next") == F.col("m2")))
    out.append(pairs.groupBy("rating").agg(F.every(F.col("main_score") >= F.col("s2")).alias("ok")).select("rating", F.lit("order").alias("check"), "ok"))
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


__all__ = ["Settings", "features", "rank_first", "rank_second", "summary", "targets", "admit", "select_second", "years", "years_second", "validate", "replace"]
