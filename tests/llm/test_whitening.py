"""Operator 12 against exact sums and a Jacobi eigen-solve in 60 digits."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from wakeline.llm import whitening
from wakeline.llm.queries import QUERIES

NAMES = "vec_id long, embedding array<double>, label int, x string, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], NAMES)


def jacobi(a):
    """(values, vectors) of a symmetric matrix of decimals by cyclic rotations, by falling value."""
    d = len(a)
    a, v = [row[:] for row in a], [[Decimal(int(i == j)) for j in range(d)] for i in range(d)]
    for _ in range(14):
        for p in range(d):
            for q in range(p + 1, d):
                if a[p][q] == 0:
                    continue
                t = (a[q][q] - a[p][p]) / (2 * a[p][q])
                t = (1 if t >= 0 else -1) / (abs(t) + (t * t + 1).sqrt())
                c = 1 / (t * t + 1).sqrt()
                s = t * c
                for m in (a, v):
                    for row in m:
                        row[p], row[q] = c * row[p] - s * row[q], s * row[p] + c * row[q]
                a[p], a[q] = [c * x - s * y for x, y in zip(a[p], a[q])], [s * x + c * y for x, y in zip(a[p], a[q])]
    order = sorted(range(d), key=lambda i: -a[i][i])
    return [a[i][i] for i in order], [[v[r][i] for r in range(d)] for i in order]


def plain(rows):
    """{(id, component): (n, deviation, whitened, explained)} with exact sums; ids must differ."""
    with localcontext() as context:
        context.prec = 60
        kept = {i: [math.floor(Fraction(c) * 256) for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
        fit = sorted(set(map(tuple, kept.values())))
        n, d = len(fit), len(fit[0])
        sums = [sum(x[j] for x in fit) for j in range(d)]
        off = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
        cov = [[Decimal(sum(o[i] * o[j] for o in off)) / n**3 for j in range(d)] for i in range(d)]
        values, vecs = jacobi(cov)
        trace = sum(cov[i][i] for i in range(d))
        out = {}
        for i, x in kept.items():
            o = [n * a - s for a, s in zip(x, sums)]
            for k in range(min(4, d)):
                flat = values[k] <= Decimal(10) ** -24 * values[0] or values[0] == 0
                w = None if flat else float(sum(Decimal(a) * b for a, b in zip(o, vecs[k])) / n / values[k].sqrt())
                out[i, k + 1] = n, sum(a * a for a in o), w, 0.0 if flat else float(values[k] / trace)
        return out


def same(spark, rows, tolerance=1e-9):
    want, got = plain(rows), {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, rows).repartition(3)).collect()}
    assert set(got) == set(want)
    signs = {}
    for (i, k), (n, deviation, w, explained) in want.items():
        r = got[i, k]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9, abs=1e-30)
        assert (r.whitened is None) == (w is None)
        if w is not None:
            if k not in signs and abs(w) > 1e-3:
                signs[k] = math.copysign(1.0, w * r.whitened)
            assert r.whitened * signs.get(k, 1.0) == pytest.approx(w, abs=tolerance, rel=tolerance)
            assert r.identity_error < 1e-9
    return got


def test_like_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [1, 2, 3, 0.5, 0.25, 4], 6)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # copies count once
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (2004, [0.0] * 6), (2005, [-0.0] * 6), (2006, [-0.001] + [0.0] * 5)]
    assert len(same(spark, rows)) == 4 * 303


def test_large_means_and_graded_scales(spark):
    """Variances a factor of 10^13 apart, far from the origin: a plain double covariance loses the small ones."""
    rng = np.random.default_rng(4)
    scale = np.array([1e6, 1.0, 0.9, 0.7, 0.5])
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    x = rng.normal(size=(150, 5)) * scale @ turn.T + 1e9
    same(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], 1e-6)


def test_flat_and_dependent(spark):
    assert all(r.whitened is None and r.identity_error is None for r in same(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).values())
    got = same(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])
    assert {k for (_, k), r in got.items() if r.whitened is not None} == {1}
    cross = [(j, [float(c) for c in v]) for j, v in enumerate(np.vstack([np.eye(4), -np.eye(4)]) * 3)]
    assert {r.identity_error < 1e-9 for r in whitening.whiten(vectors(spark, cross)).collect()} == {True}  # equal eigenvalues


def test_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 5.0]), (4, []), (5, [1.0]), (6, [0.5, 0.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1), (3, 2), (6, 1), (6, 2)] and {r.n for r in got} == {3}
    huge = whitening.whiten(vectors(spark, [(1, [1e200, 1.0]), (2, [-1e200, 2.0]), (3, [0.0, 0.0])])).collect()
    # The second variance is below FLAT of the first: no component.
    assert len(huge) == 6 and all(math.isfinite(r.whitened) if r.component == 1 else r.whitened is None for r in huge)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-(10**9), 10**9, (2500, 4)) + np.array([10**12, 0, 7, -(10**10)])
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)]
    c = whitening.centred(x, n, sums)
    high, low = whitening.product(c, c)
    off = np.array([[n * int(v) - s for v, s in zip(r, sums)] for r in x.tolist()], dtype=object)
    exact = off.T @ off
    for i in range(4):
        for j in range(4):
            error = abs((Fraction(high[i, j]) + Fraction(low[i, j])) * n * n - exact[i, j])
            assert error * error <= Fraction(2) ** -190 * exact[i, i] * exact[j, j]


def test_query(spark, sf_dir):
    got = QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x = np.floor(np.array([v for _, v in rows]) * 256)
    distinct = np.unique(x, axis=0)
    values, vecs = np.linalg.eigh(np.cov(distinct.T, bias=True))
    for k in range(4):
        w = (x - distinct.mean(0)) @ vecs[:, -1 - k] / np.sqrt(values[-1 - k])
        mine = {r.vec_id: r for r in got.filter(f"component = {k + 1}").collect()}
        own = np.array([mine[i].whitened for i, _ in rows])
        assert min(np.abs(own - w).max(), np.abs(own + w).max()) < 1e-8
        assert all(abs(r.explained - values[-1 - k] / values.sum()) < 1e-12 and r.identity_error < 1e-12 for r in mine.values())
