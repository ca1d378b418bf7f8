import random
import statistics

import numpy as np
import pytest

from lakeloom.functions import windows
from lakeloom.functions.windows import Moments, Span


def test_moments_against_counting():
    rng = np.random.default_rng(1)
    for n, days in ((0, 1), (1, 1), (50, 7), (300, 90)):
        t, w = rng.integers(0, days, n), rng.integers(1, 5, n)
        m = Moments(t, w, max(1, days.bit_length()))
        r, last = rng.integers(0, n + 1, 200), rng.integers(-1, days, 200)
        assert m.until(r, last).tolist() == [int(w[:a][t[:a] <= b].sum()) for a, b in zip(r, last)]


@pytest.mark.parametrize("few", [0, 2000])
def test_spans_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(windows, "FEW", few)
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([None, 1, 2]), "x") for k in range(300)]
    rows += [(1000 + k, "hot", 5, 3, 1, "x") for k in range(200)] + [(2000, "a", 10, 3, 1, "x")] * 3
    data = [(k, g, t, v, c, None if t is None else t - 3, None if t is None else t + 2, None if t is None else t - 100, None if t is None else t + 100, n) for k, g, t, v, c, n in rows]
    df = spark.createDataFrame(data, "id long, g string, t long, v long, c int, lo long, hi long, lo2 long, hi2 long, id2 string")
    got = windows.window_ranks(df, ["g"], "t", "v", [Span("near", "lo", "hi"), Span("cls", "lo", "hi", "c"), Span("far", "lo2", "hi2", "c")]).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, lo, hi, by in (("near", r.lo, r.hi, False), ("cls", r.lo, r.hi, True), ("far", r.lo2, r.hi2, True)):
            have = [r[f"{name}_{x}"] for x in ("n", "less", "equal")]
            if r.t is None or r.v is None or by and r.c is None:
                assert have == [None] * 3
                continue
            seen = [v for _, g, t, v, c, *_ in data if g == r.g and t is not None and v is not None and lo <= t <= hi and (not by or c == r.c)]
            assert have == [len(seen), sum(v < r.v for v in seen), sum(v == r.v for v in seen)]
    assert windows.window_ranks(df.limit(0), ["g"], "t", "v", [Span("near", "lo", "hi")]).count() == 0


def test_medians_of_windows(spark):
    rng = random.Random(3)
    points = [(rng.choice(["a", None]), rng.randrange(20), rng.choice([0, 1, 2, 5, 80, 200])) for _ in range(200)]
    p = spark.createDataFrame(points, "g string, t long, m long")
    rows = spark.createDataFrame([(g, lo, lo + 4, "x") for g in ("a", None, "none") for lo in range(-6, 24)] + [("a", None, 3, "x")], "g string, lo long, hi long, median string").drop("median")
    for r in windows.window_medians(rows, ["g"], "lo", "hi", p, "t", "m").collect():
        seen = [min(m, 81) for g, t, m in points if g == r.g and r.lo is not None and r.lo <= t <= r.hi and m > 0]
        assert r.median == (statistics.median(seen) if seen else None)
