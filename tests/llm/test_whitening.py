import math
from fractions import Fraction

import numpy as np
import pytest

from gleaner.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, whitened int"


def rows_of(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "extra", 7) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors):
    """x, mean and covariance with exact numbers, eigenvectors by the library."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    scatter = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(d)] for i in range(d)]
    cov = np.array([[float(Fraction(v, n**3)) for v in r] for r in scatter])
    e, axes = np.linalg.eigh(cov)
    return x, n, sums, cov, e[::-1], axes.T[::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_jacobi_is_the_decomposition(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 3 * d))
    a = a @ a.T
    values, axes = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
    assert np.abs(axes @ axes.T - np.eye(d)).max() < 1e-13
    assert np.abs(axes @ a @ axes.T - np.diag(values)).max() < 1e-11 * values[0]


def test_small_eigenvalues_are_accurate():
    scale = np.diag([1.0, 1e-5, 1e-10, 1e-15])
    inner = np.eye(4) + 0.2 * (np.ones((4, 4)) - np.eye(4))
    values, _ = whitening.jacobi(scale @ inner @ scale)
    from decimal import Decimal, getcontext

    getcontext().prec = 90  # the product of eigenvalues is the determinant, which an absolute error of 1e-16 would swamp
    det = Decimal(float(np.linalg.det(inner))) * (Decimal("1e-30") ** 2)
    got = math.prod(map(Decimal, values.tolist()))
    assert abs(got / det - 1) < Decimal("1e-12")
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("n,d", [(150, 5), (60, 40)])
def test_report_against_exact_numbers(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).tolist()
    got = whitening.report(rows_of(spark, vectors).repartition(5)).collect()
    x, n, sums, cov, e, axes = plain(vectors)
    k = min(d, 32)
    assert len(got) == n * k
    w = np.zeros((n, k))
    for r in got:
        i, c = r.vec_id, r.component - 1
        w[i, c] = r.whitened
        assert r.n == n
        assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[i], sums, strict=True))
        assert abs(r.explained / (e[c] / np.trace(cov)) - 1) < 1e-10
        assert r.identity_error < 1e-9
    want = (np.array(x) - np.array(sums) / n) @ (axes[:k] / np.sqrt(e[:k])[:, None]).T
    turned = np.sign((w * want).sum(axis=0))
    assert np.abs(w * turned - want).max() < 1e-6


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = rng.normal(size=(30, 3)).tolist()
    odd = [None, [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 0.0, 0.0], [], [4.0], [4.0], [1e300, -1e300, 0.0, 5.0]]
    df = rows_of(spark, [*good, *odd, good[0]])
    got = whitening.report(df.withColumn("vec_id", df.vec_id.cast("long"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {**dict.fromkeys([*range(30), 38], 3), 35: 1, 36: 1, 37: 4}
    assert by[0][0].n == 31 and by[0][0].whitened == by[38][0].whitened  # a repeated row
    assert by[35][0].whitened is None and by[35][0].deviation == 0 and by[35][0].explained == 0  # equal rows: no variance
    assert by[37][0].whitened is None
    assert whitening.report(df.limit(0)).count() == 0
    assert whitening.report(df.filter("vec_id = 35")).collect()[0].whitened is None


def test_deviation_beyond_the_quick_path():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4], [5, 6]], np.int64)
    sums = [int(v) for v in x.sum(axis=0)]
    m = whitening.Model(3, sums, np.array([round(s / 3) for s in sums], np.int64), np.zeros(2), np.eye(2), 1.0)
    want = [sum((3 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    assert whitening._deviation(x, m) == [w if w < 1 << 63 else None for w in want]


def test_general_form_keeps_columns(spark):
    rng = np.random.default_rng(9)
    df = rows_of(spark, rng.normal(size=(50, 6)).tolist()).withColumn("v", whitening.fixed_point("embedding", 1000, 0)).repartition(3)
    models = whitening.fit(df, "v")
    out = whitening.whitened(df, models, "v", 4)
    assert set(out.columns) == {*df.columns}
    w = np.array([r.whitened for r in out.collect()])
    assert w.shape == (50, 4)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    assert whitening.identity_errors(df, models, "v", 4)[6] < 1e-9
