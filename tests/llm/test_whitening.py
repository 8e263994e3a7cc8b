"""Whitening against exact rational arithmetic and numpy's eigenvectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from foliomill.llm import queries, whitening


def plain_polynomial(matrix):
    """Faddeev-LeVerrier: coefficients of det(x - matrix), lowest first."""
    d = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, coefficients = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)]
        coefficients.append(-sum(am) / k)
    return [int(c) for c in reversed(coefficients)]


def plain(vectors, components):
    """(n, deviations, e, trace, whitened up to signs) by numpy, on the usable vectors."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1000000
    n, s = len(x), x.sum(0)
    deviations = [int(v) for v in ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)]
    centred = x - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviations, e, np.trace(centred.T @ centred / n), centred @ axes / np.sqrt(np.maximum(e, 1e-300))


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial(spark, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-50, 50, (d + 2, d)).astype(object)
    for m in (x.T @ x, np.diag([3] * d).astype(object), np.zeros((d, d), dtype=object) + 4):
        assert whitening.characteristic_polynomial(spark, m) == plain_polynomial(m)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for reach in (5, 1 << 19, 1 << 21, 1 << 45, 1 << 60):
        x = rng.integers(-reach, reach, (50, 3))
        assert (whitening.exact_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_roots_with_multiplicity():
    poly = [1]
    for root in (7, 7, 7, 5, 4, 4, 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    found = whitening.largest_roots(poly, 6, 31)
    assert [(Fraction(at, 1 << shift), m) for at, shift, m, _ in found] == [(7, 3), (5, 1), (4, 2)]
    two = [(1 << 80) - 1, -(2 << 40), 1]
    (a, s, _, _), (b, t, _, _) = whitening.largest_roots(two, 2, 1 << 41)
    assert (Fraction(a, 1 << s), Fraction(b, 1 << t)) == ((1 << 40) + 1, (1 << 40) - 1)
    irrational = whitening.largest_roots([1, -4, 1], 2, 4)  # 2 +- sqrt(3)
    assert [round(a / 2**s, 12) for a, s, _, _ in irrational] == [round(2 + math.sqrt(3), 12), round(2 - math.sqrt(3), 12)]


@pytest.mark.parametrize("n,d", [(200, 6), (4, 10), (60, 40)])
def test_whitening_equals_numpy(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d)).tolist()
    frame = table_of(spark, vectors)
    model = whitening.learn(frame, components=5)
    got = sorted(whitening.transform(frame, model).collect(), key=lambda r: r.vec_id)
    size, deviations, e, trace, white = plain(vectors, len(model.eigenvalues))
    assert model.n == size and [r.deviation for r in got] == deviations
    assert len(model.eigenvalues) == min(5, n - 1, d)
    np.testing.assert_allclose(model.eigenvalues, e, rtol=1e-9)
    np.testing.assert_allclose(model.explained, e / trace, rtol=1e-9)
    mine = np.array([r.whitened for r in got])
    signs = np.sign((mine * white).sum(0))
    np.testing.assert_allclose(mine * signs, white, atol=1e-7)
    error = whitening.identity_error(whitening.transform(frame, model), model)
    assert error == pytest.approx(np.abs(np.cov(mine.T, bias=True) - np.eye(mine.shape[1])).max(), abs=1e-12) and error < 1e-9


def test_equal_eigenvalues_give_an_orthonormal_basis(spark):
    vectors = [[s * 2.0 if i == j else 0.0 for j in range(4)] for i in range(4) for s in (1, -1)]
    frame = table_of(spark, vectors)
    model = whitening.learn(frame, components=3)
    assert len(set(model.eigenvalues)) == 1
    np.testing.assert_allclose(model.components @ model.components.T, np.eye(3), atol=1e-15)
    assert whitening.identity_error(whitening.transform(frame, model), model) < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (2, [3.0, -1.0], 7), (3, None, 7), (4, [1.0, None], 7), (5, [nan, 1.0], 7), (6, [1.0, -inf], 7), (7, [], 7), (8, [1.0], 7), (9, [1e300, 0.0], 7), (None, [0.5, 0.5], 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened int").repartition(3)
    model = whitening.learn(frame)
    got = whitening.transform(frame, model)
    assert got.columns == ["vec_id", "embedding", "deviation", "whitened"]
    assert sorted((r.vec_id or 0) for r in got.collect()) == [0, 1, 1, 2] and model.n == 4 and len(model.eigenvalues) == 2
    for bad in (frame.limit(0), frame.where("vec_id = 1"), frame.where("vec_id = 3")):
        model = whitening.learn(bad)
        assert len(model.eigenvalues) == 0 and all(list(r.whitened) == [] for r in whitening.transform(bad, model).collect())
        assert whitening.identity_error(whitening.transform(bad, model), model) == 0.0


def test_deviation_beyond_a_long_is_null(spark):
    frame = table_of(spark, [[1e16, 0.0], [-1e16, 1.0]])
    assert [r.deviation for r in whitening.transform(frame, whitening.learn(frame)).collect()] == [None, None]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, e, trace, white = plain([r.embedding for r in rows], 32)
    got = sorted(queries.op13_whiten_embeddings(spark, sf_dir).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == n * 32 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert [r.deviation for r in got[::32]] == deviations
    np.testing.assert_allclose([r.explained for r in got[:32]], e / trace, rtol=1e-9)
    mine = np.array([r.whitened for r in got]).reshape(n, 32)
    np.testing.assert_allclose(np.abs((mine * white).sum(0) / n), 1, atol=1e-6)
