"""Population ranking over a frozen input: heat, percentiles, calendar cohorts, scores, routes.

No step gathers a rating, a bucket or a window in one task: ranks come from counted values (see
functions.stats), and a row's place within its own calendar window from functions.windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.functions import windows
from lakeloom.functions.runtime import stored
from lakeloom.functions.stats import bucket, clamp, midranks, shrunk
from lakeloom.plans.paging import positions

DAY = 86_400_000_000
#: Edges of the age buckets in days.
BASE, COARSE, BROAD = [0, 3, 7, 14, 30, 90, 365, 1095, 2555], [0, 7, 30, 365, 2555], [0, 30, 365, 2555]
#: The cohort ladder, months to each side and buckets.
LADDER = [(6, BASE), (12, BASE), (24, BASE), (24, COARSE), (24, BROAD)]


def heat(fav: Column, up: Column) -> Column:
    """(favourites + 1)(votes + 1), exact; of a missing counter the other one stands for both."""
    f, u = (F.when(c >= 0, c) + 1 for c in (fav, up))
    big = lambda c: c.cast("decimal(19,0)")
    return F.coalesce(big(f) * big(u), big(f) * big(f), big(u) * big(u))


def age(created: Column, observed: Column, date_only: Column) -> tuple[Column, Column]:
    """(least, most) age in microseconds; a date without a time is a day's width, an age below 0 unknown."""
    upper = observed - created
    lower = F.greatest(F.lit(0), F.when(date_only, upper - DAY + 1).otherwise(upper))
    return F.when(upper >= 0, lower), F.when(upper >= 0, upper)


def vote_penalty(up: Column, down: Column, prior: Column) -> Column:
    """0..1 for a share of votes against that is above the population's; needs three of them."""
    smooth = (down + 20 * prior) / (up + down + 20)
    return F.when(down >= 3, clamp((smooth - prior - 0.05) / 0.25, 0.0, 1.0)).otherwise(0.0)


def tie_key(domain: str, seed: str, key: Column) -> Column:
    """A hash that orders equal scores the same way in every run: sha256 of domain, seed and key."""
    size = len(seed.encode()).to_bytes(8, "big").hex()
    head = (domain.encode() + b"\0").hex() + size + seed.encode().hex()
    return F.sha2(F.concat(F.unhex(F.lit(head)), F.encode(key, "utf-8")), 256)


# --- windows over time ----------------------------------------------------------------------------


def nodes(t: str, levels: int) -> Column:
    """The tree nodes that hold a moment: one on every level."""
    return F.expr(f"transform(sequence(0, {levels - 1}), k -> named_struct('k', k, 'i', shiftright({t}, k)))")


def cover(lo: str, hi: str, levels: int) -> Column:
    """The fewest tree nodes that make up lo..hi: at most two on a level."""
    state = "struct<lo:bigint,hi:bigint,nodes:array<struct<k:int,i:bigint>>>"
    step = """named_struct(
        'lo', IF(s.lo > s.hi, s.lo, shiftright(s.lo + IF(s.lo % 2 = 1, 1, 0), 1)), 'hi', IF(s.lo > s.hi, s.hi, shiftright(s.hi - IF(s.hi % 2 = 0, 1, 0), 1)),
        'nodes', IF(s.lo > s.hi, s.nodes, concat(s.nodes, IF(s.lo % 2 = 1, array(named_struct('k', k, 'i', s.lo)), array()),
            IF(s.hi % 2 = 0 AND (s.hi > s.lo OR s.lo % 2 = 0), array(named_struct('k', k, 'i', s.hi)), array()))))"""
    return F.expr(f"aggregate(sequence(0, {levels - 1}), CAST(named_struct('lo', {lo}, 'hi', {hi}, 'nodes', array()) AS {state}), (s, k) -> CAST({step} AS {state}), s -> s.nodes)")


def window_ranks(rows: DataFrame, group: list[str], t: str, lo: str, hi: str, value: str) -> DataFrame:
    """rows with n, less and equal: how many rows of the group lie at times lo..hi (inclusive), and
    how many of them have a smaller or the same value (see functions.windows)."""
    return windows.window_ranks(rows, group, t, value, [windows.Span("w", lo, hi)]).withColumnsRenamed({"w_n": "n", "w_less": "less", "w_equal": "equal"})


def months_window(created: Column, months: int) -> tuple[Column, Column]:
    """created minus and plus calendar months (clamped at the end of a month), as timestamps."""
    step = F.make_interval(F.lit(0), F.lit(months))
    return created - step, created + step


def cohort_percentiles(rows: DataFrame, group: list[str], created: str, lower: str, upper: str, value: str, least: int, ladder: list[tuple[int, list[int]]] = LADDER, weight: str | None = None) -> DataFrame:
    """rows with level, cohort_n and local: the mid-rank percentile among rows of the same age bucket
    created within the months around, on the first level of the ladder with at least least rows. All
    levels are counted in one pass. weight: the column of how often each row counts."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    cols, spans = {"__t": day(F.col(created))}, []
    for level, (months, edges) in enumerate(ladder):
        lo, hi = months_window(F.col(created), months)
        cls = "__b" + "_".join(map(str, edges))
        cols |= {f"__lo{months}": day(lo), f"__hi{months}": day(hi), cls: bucket(F.col(lower), F.col(upper), [e * DAY for e in edges])}
        spans.append(windows.Span(f"__{level}", f"__lo{months}", f"__hi{months}", cls))
    found = windows.window_ranks(rows.withColumns(cols), group, "__t", value, spans, weight)
    enough = lambda k: F.col(f"__{k}_n") >= least
    first = lambda pick: F.coalesce(*[F.when(enough(k), pick(k)) for k in range(len(spans))])
    out = found.withColumns({
        "level": first(lambda k: F.lit(k)), "cohort_n": first(lambda k: F.col(f"__{k}_n")),
        "local": first(lambda k: (F.col(f"__{k}_less") + F.col(f"__{k}_equal") / 2) / F.col(f"__{k}_n")),
    })
    return out.drop(*cols, *[f"{s.name}_{c}" for s in spans for c in ("n", "less", "equal")])


# --- calendar feathering, quotas, routes ------------------------------------------------------------


def feather(us: Column, year_start_us: Column, next_year_us: Column, days: int) -> tuple[Column, Column, Column]:
    """(left year offset, right year offset, weight of the right): smoothstep within days of a new year."""
    width = 2 * days * DAY
    into, ahead = us - year_start_us, next_year_us - us
    x = F.when(into < days * DAY, (into + days * DAY) / width).when(ahead <= days * DAY, (days * DAY - ahead) / width)
    weight = x * x * (3 - 2 * x)
    left = F.when(into < days * DAY, -1).otherwise(0)
    right = F.when((into >= days * DAY) & (ahead <= days * DAY), 1).otherwise(0)
    return left, right, F.coalesce(weight, F.lit(1.0))


def quotas(n: int, per_mille: list[int]) -> list[int]:
    """Whole shares of n by largest remainder; equal remainders go to the earlier one, rest is left."""
    exact = [n * p for p in per_mille]
    out = [e // 1000 for e in exact]
    spare = sum(exact) // 1000 - sum(out)
    for i in sorted(range(len(exact)), key=lambda i: (-(exact[i] % 1000), i))[:spare]:
        out[i] += 1
    return out


def routes(rows: DataFrame, group: str, main: str, rescue: str, audit: Column, key: str, shares: list[int], ties: str | None = None) -> DataFrame:
    """rows with route: per group the first by main, then of the others the first by rescue, then by
    hash, the rest rejected. Each group's numbers are whole shares of its size; the groups are few
    (their sizes come to the driver), their rows are numbered over all tasks."""
    sizes = {r[0]: quotas(r[1], shares) for r in rows.groupBy(group).count().collect()}
    limit = lambda k: F.coalesce(F.element_at(F.create_map(*[x for g, q in sizes.items() for x in (F.lit(g), F.lit(q[k]))]), F.col(group)), F.lit(0)) if sizes else F.lit(0)
    tie = [ties] if ties else []
    narrow = stored(rows.select(*dict.fromkeys([key, group, main, rescue, *tie]), audit.alias("__audit")))
    left, out = narrow, []
    for k, (route, order) in enumerate((("main", F.col(main).desc_nulls_last()), ("rescue", F.col(rescue).desc_nulls_last()), ("audit", F.col("__audit").asc()))):
        need = {0: [main, *tie], 1: [rescue, *tie], 2: ["__audit"]}[k]
        placed = positions(left.select(*dict.fromkeys([key, group, *need])), [order, *map(F.col, need[1:]), F.col(key)], [group])
        out.append(stored(placed.where(F.col("position") <= limit(k)).select(F.col(key).alias("__key"), F.lit(route).alias("route"))))
        left = left.join(out[-1], F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    chosen = out[0].unionByName(out[1]).unionByName(out[2])
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("route", F.coalesce("route", F.lit("rejected")))


def capacities(counts: dict[int, int], budget: int) -> tuple[dict[int, int], int]:
    """Budget per year in proportion to its rows, none beyond them; what a year can't take is free."""
    total = sum(counts.values())
    if not total:
        return {}, budget
    years = sorted(counts)
    exact = {y: budget * counts[y] for y in years}
    share = {y: exact[y] // total for y in years}
    for y in sorted(years, key=lambda y: (-(exact[y] % total), y))[: budget - sum(share.values())]:
        share[y] += 1
    return {y: min(share[y], counts[y]) for y in years}, budget - sum(min(share[y], counts[y]) for y in years)


def select_by_year(rows: DataFrame, year: str, score: str, key: str, budget: int) -> DataFrame:
    """The budget's rows: each year's best up to its capacity, then the best of all others on the free
    slots. Ranks are numbered over all tasks; only a count per year comes to the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(year).count().collect()}
    share, free = capacities(counts, min(budget, sum(counts.values())))
    table = F.create_map(*[x for y, c in share.items() for x in (F.lit(y), F.lit(c))]) if share else F.create_map(F.lit(0), F.lit(0))
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    placed = stored(positions(rows, order, [year]).withColumn("__in", F.col("position") <= F.coalesce(F.element_at(table, F.col(year)), F.lit(0))).drop("position"))
    own = placed.where("__in").drop("__in").withColumn("slot", F.lit("year"))
    spare = placed.where("NOT __in").drop("__in")
    if free <= 0:
        return own
    return own.unionByName(positions(spare, order, []).where(F.col("position") <= free).drop("position").withColumn("slot", F.lit("free")))


def scores(rows: DataFrame, g: str, c: str, prior: str, vote: str, wt: float = 0.3, wa: float = 0.0, wv: float = 0.08) -> DataFrame:
    """rows with main and rescue scores of the percentiles g (all) and c (cohort)."""
    G, L, A, V = (F.col(x) for x in (g, c, prior, vote))
    main = 100 * clamp(G + wt * F.greatest(L - G, F.lit(0.0)) - wv * V, 0.0, 1.0)
    return rows.withColumns({"main": main, "rescue": 100 * clamp(L + wa * A * (1 - L) - wv * V, 0.0, 1.0)})


__all__ = ["heat", "age", "vote_penalty", "tie_key", "window_ranks", "cohort_percentiles", "feather", "quotas", "routes", "select_by_year", "scores", "midranks", "shrunk"]


def window_sums(rows: DataFrame, group: list[str], t: str, lo: str, hi: str, value: str) -> DataFrame:
    """rows with n and sum of the values of the group's rows at times lo..hi (inclusive), by the same
    tree as window_ranks; a null value or time isn't counted."""
    known = rows.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    ends = known.agg(F.min(t), F.max(t)).first()  # two numbers
    if ends[0] is None:
        return rows.withColumns({"n": F.lit(None).cast("long"), "sum": F.lit(None).cast("double")})
    base, levels = ends[0], max(1, (ends[1] - ends[0]).bit_length() + 1)
    held = known.select(*group, F.explode(nodes(f"({t} - {base})", levels)).alias("node"), F.col(value).cast("double").alias("v")).groupBy(*group, "node").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    asked = rows.select(*group, F.col(lo).alias("__lo"), F.col(hi).alias("__hi")).where("__lo IS NOT NULL AND __hi IS NOT NULL").distinct()
    inner = asked.withColumn("a", F.expr(f"CAST(greatest(0, __lo - {base}) AS bigint)")).withColumn("b", F.expr(f"CAST(least({ends[1] - base}, __hi - {base}) AS bigint)"))
    found = inner.select(*group, "__lo", "__hi", F.explode(cover("a", "b", levels)).alias("node")).join(held, [*group, "node"])
    sums = found.groupBy(*group, "__lo", "__hi").agg(F.sum("n").alias("n"), F.sum("s").alias("sum")).withColumnsRenamed({g: f"__{g}" for g in group})
    same = [F.col(lo) == F.col("__lo"), F.col(hi) == F.col("__hi"), *[F.col(g) == F.col(f"__{g}") for g in group]]
    return rows.join(sums, same, "left").drop("__lo", "__hi", *[f"__{g}" for g in group])


def maker_prior(rows: DataFrame, maker: list[str], t: str, lo: str, hi: str, value: str, mean: Column, weight: int = 50, least: int = 5) -> DataFrame:
    """rows with prior, 0..1: how far the maker's other items in the window lie above the mean, drawn
    to it by weight items; 0 for fewer than least others."""
    w = window_sums(rows, maker, t, lo, hi, value)
    own = F.when((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi)), F.col(value).cast("double"))
    others, total = F.coalesce("n", F.lit(0)) - F.when(own.isNotNull(), 1).otherwise(0), F.coalesce("sum", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
    posterior = (total + weight * mean) / (others + weight)
    return w.withColumn("prior", F.when(others >= least, clamp((posterior - mean) / 0.2, 0.0, 1.0)).otherwise(0.0)).drop("n", "sum")


def duplicate_heat(rows: DataFrame, group: str, key: str, kind: str, fav: str, up: str, created: str, policy: str, shown: int = 3) -> DataFrame:
    """One row per group of duplicate posts: its posts, heat, first creation, whether their kinds differ,
    and the hottest posts as evidence. highest: the heat of the best post; sum: of the summed counters
    (exact; beyond 64 bits they stay at the limit)."""
    from lakeloom.functions.top import first_k

    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), limit).cast("long")
    hot = rows.withColumn("__heat", heat(F.col(fav), F.col(up)))
    all_ = hot.groupBy(group).agg(F.count("*").alias("posts"), F.max("__heat").alias("best"), total(fav).alias("__f"), total(up).alias("__u"), F.min(created).alias("created"), (F.min(kind) != F.max(kind)).alias("kinds_differ"))
    value = F.col("best") if policy == "highest" else heat(F.col("__f"), F.col("__u"))
    top = first_k(hot, [group], [F.col("__heat").desc_nulls_last(), F.col(key)], shown, F.col(key), "evidence")
    return all_.join(top, group).select(group, "posts", value.alias("heat"), "created", "kinds_differ", "evidence")
