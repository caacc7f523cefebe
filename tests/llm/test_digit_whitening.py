"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import digit_whitening as dw

SCHEMA = "vec_id long, embedding array<double>, id string, x string, n string, size string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], SCHEMA)


def plain(rows, components=4):
    """{(id, occurrence, component): (n, deviation, |whitened|, explained)} by fractions and one eigendecomposition."""
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, dims = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit, strict=True)]
    cov = [[sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n for b in range(dims)] for a in range(dims)]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    trace, out = float(sum(cov[a][a] for a in range(dims))), []
    for i, x in ok:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        gap = np.array([float(a - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        for k in range(min(components, dims)):
            out.append((i, k + 1, n, deviation, abs(gap @ vectors[:, -1 - k]) / math.sqrt(values[-1 - k]), values[-1 - k] / trace))
    return out


def rows_of(rng, count=120, dims=5):
    base = rng.normal(size=(count, dims)) @ np.diag(np.arange(1, dims + 1))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(500 + k, rows[0][1]) for k in range(60)] + [(3, rows[3][1]), (None, rows[4][1])]
    return rows + [(900, None), (901, [None] + [1.0] * (dims - 1)), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, []), (905, [-0.0] * dims)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], *r[2:4], r[4])


@pytest.mark.parametrize("factor", [1.0, 512.0])
def test_whitening_equals_fractions(spark, factor):
    rows = [(i, v and [None if c is None else c * factor for c in v]) for i, v in rows_of(np.random.default_rng(2))]
    got = sorted((tuple(r) for r in dw.whiten(table(spark, rows)).collect()), key=lambda r: key((*r[:4], abs(r[4]))))
    want = sorted(plain(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[4]) == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


def test_digit_products_are_exact_for_numbers_of_any_size():
    rng = np.random.default_rng(5)
    for bits in (3, 19, 20, 40, 62):
        y = rng.integers(-(2**bits), 2**bits, size=(5_000, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert dw.exact_gram(y).tolist() == want and dw.exact_gram(y.astype(object)).tolist() == want
    big = np.array([3**70, -(2**90), 0, -1, 2**31, -(2**31)], dtype=object)
    assert sum((d.astype(object) << 32 * k) for k, d in enumerate(dw.digits(big, 32))).tolist() == big.tolist()
    x = np.array([[2**62, -(2**63)], [5, 7]])
    assert dw.centred(x, 1000, [3, -(2**64)]).tolist() == [[1000 * 2**62 - 3, -1000 * 2**63 + 2**64], [4997, 7000 + 2**64]]


def test_lengths_apart_no_variance_and_empty_tables(spark):
    rows = [(1, [0.5, 1.5]), (2, [0.25, 0.0]), (3, [-1.0, 2.0]), (4, [1.0] * 6), (5, [1.0] * 6), (6, [0.5])]
    got = {(r["vec_id"], r["component"]): r for r in dw.whiten(table(spark, rows)).collect()}
    assert sorted(k for k in got if k[0] < 4) == [(i, c) for i in (1, 2, 3) for c in (1, 2)] and got[1, 1]["n"] == 3
    assert len([k for k in got if k[0] == 4]) == 4 and got[4, 1]["whitened"] is None and got[4, 1]["explained"] is None and got[4, 1]["identity_error"] is None and got[5, 1]["deviation"] == 0
    assert got[6, 1]["n"] == 1
    assert dw.whiten(table(spark, [])).count() == 0


def test_what_fits_no_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        dw.whiten(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        dw.whiten(table(spark, [(1, [1e15, 0.0]), (2, [0.0, 1.0])])).collect()
