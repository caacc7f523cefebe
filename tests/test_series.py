"""Series in many pieces against plain loops over the whole."""

import math
import random

import numpy as np
import pytest

from millrace.operators import graphs, series
from millrace.session import discard, written


@pytest.fixture(autouse=True)
def short_pieces(monkeypatch):
    monkeypatch.setattr(series, "PIECE", 7)
    monkeypatch.setattr(series, "MAPS", 3)


def test_numbers_of_one_hot_key_and_of_equal_rows(spark):
    rows = [(1, i % 5) for i in range(500)] + [(2, 3), (None, 4), (None, 4)]
    got = [tuple(r) for r in series.numbered(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"], written).collect()]
    for key in (1, 2, None):
        mine = sorted((p, v) for k, v, p in got if k == key)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)
    assert sorted(p for *_, p in series.numbered(spark.createDataFrame(rows, "k int, v int"), [], ["v"], written).collect()) == list(range(503))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 14, 15, 16, 100])
def test_chords_and_splines_of_any_length(spark, n):
    rng = np.random.default_rng(n)
    points = [(1, float(u), float(y)) for u, y in zip(np.cumsum(rng.random(n) + 0.1), rng.normal(size=n), strict=True)] + [(2, 0.0, 1.0), (2, 1.0, 1.5), (2, 3.0, -1.0)]
    df = spark.createDataFrame(points, "k int, u double, y double")
    m = {(r["k"], r["u"]): r["m"] for r in series.natural_spline(df, "k", "u", "y", written).collect()}
    lengths = {(r["k"], r["u"]): r["s"] for r in series.chord_length(df, ["k"], "u", ["u", "y"], written, "s").collect()}
    assert len(m) == len(lengths) == len(points)
    for key in (1, 2):
        mine = [p[1:] for p in points if p[0] == key]
        size = len(mine)
        u, y = np.array([p[0] for p in mine]), np.array([p[1] for p in mine])
        whole = np.zeros((size, size))
        right = np.zeros(size)
        for i in range(size):
            if i in (0, size - 1):
                whole[i, i] = 1
                continue
            h0, h1 = u[i] - u[i - 1], u[i + 1] - u[i]
            whole[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
            right[i] = (y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0
        want = np.linalg.solve(whole, right) if size else []
        assert [m[key, x] for x in u] == pytest.approx(list(want), abs=1e-9)
        steps = np.cumsum([0, *np.hypot(np.diff(u), np.diff(y))]) if size else np.zeros(0)
        for x, s in zip(u, steps, strict=False):
            assert lengths[key, x] == (None if not steps[-1] else pytest.approx(s / steps[-1], abs=1e-12))


def test_claims_of_one_key_in_many_pieces(spark):
    rnd = random.Random(14)
    log = [(rnd.choice([7, 7, 7, 8]), rnd.choice("abcdef"), i, rnd.choice(["claim", "release", "release"])) for i in range(900)] + [(9, "x", 0, "claim"), (9, "x", 1, "release"), (None, "a", 2, "claim"), (8, None, 3, "claim")]
    for upto in (0, 1, 50, 300, 904):
        held = {}
        for k, who, _, op in log[:upto]:
            if k is None or who is None:
                continue
            if op == "claim":
                held.setdefault(k, who)
            elif held.get(k) == who:
                del held[k]
        made = series.claimed(spark.createDataFrame(log[:upto], "k int, o string, i int, op string"), "k", "o", "i", written)
        assert dict(map(tuple, made.collect())) == held


def test_greedy_cover_of_many_sets(spark):
    rnd = random.Random(3)
    units = [sorted({rnd.randint(0, 40) for _ in range(rnd.choice([0, 1, 2, 2, 3, 3, 4]))}) for _ in range(3_000)] + [[5, 5], [7, None]]
    sets = [{k for k in u if k is not None} for u in units]
    sizes = {k: sum(k in s for s in sets) for k in set().union(*sets)}
    fixed, want = set(), []
    for step in range(25):
        gain = {k: sum(s - fixed == {k} for s in sets) for k in sizes if k not in fixed}
        best = max(sorted(gain), key=lambda k: (gain[k], sizes[k], k))
        fixed.add(best)
        want.append((step + 1, best, sum(s <= fixed for s in sets)))
    needs = spark.createDataFrame([(u,) for u in units], "classes array<int>")
    assert [tuple(r) for r in graphs.greedy_cover(needs, 25, written, discard).collect()] == want
    assert graphs.greedy_cover(needs.limit(0), 5, written, discard).count() == 0 and math.isfinite(len(want))
