"""Whitening against exact fractions and plain eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from lexiforge.llm.whitening import characteristic_polynomial, exact_gram, fit_whitening, identity_error, largest_roots, null_space, op11_whitening, polynomial_mod, primes, project
from tests.conftest import SMALL

from .data import saved


def plain_polynomial(a):
    """Faddeev and LeVerrier, in fractions."""
    d = len(a)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(a[i][x] * m[x][i] for x in range(d)) for i in range(d)) / k)
    return [int(x) for x in c]


def scatter(x):
    n = len(x)
    s = [sum(v[i] for v in x) for i in range(len(x[0]))]
    return [[n * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]


def test_polynomial(spark):
    rng = np.random.default_rng(4)
    for d, spread in ((1, 5), (2, 9), (5, 40), (9, 10**6)):
        a = scatter([[int(v) for v in row] for row in rng.integers(-spread, spread, (2 * d + 1, d))])
        assert characteristic_polynomial(spark, a) == plain_polynomial(a)
    swapped = np.array([[0, 0, 3], [0, 1, 0], [3, 0, 2]])  # a pivot is 0
    p = primes(1)[0]
    assert [c % p for c in reversed(plain_polynomial(swapped.tolist()))] == polynomial_mod(swapped, p)


def test_roots_with_multiplicity():
    # (x - 7)^3 (x - 2) x^2
    c = [1]
    for root in (7, 7, 7, 2, 0, 0):
        c = [a - root * b for a, b in zip([*c, 0], [0, *c], strict=True)]
    found = largest_roots(c, 10)
    assert [m for _, m in found] == [3, 1]
    assert [float(r) for r, _ in found] == pytest.approx([7, 2], rel=1e-20)
    close = largest_roots([10**24, -2 * 10**24 - 1, 10**24 + 1], 2)  # 1 and 1 + 1e-24
    assert close[0][0] > 1 and sum(m for _, m in close) == 2


def test_close_eigenvalues_keep_their_components():
    """Eigenvalues 1e-11 apart, where plain double precision loses the components."""
    big = 10**11
    a = [[2 * big + 1, 1, 0], [1, 2 * big + 1, 1], [0, 1, 2 * big + 2]]
    (root, many), *_ = largest_roots(plain_polynomial(a), 3)
    v = null_space(a, root, many)[:, 0]
    small = np.linalg.eigh(np.array([[1.0, 1, 0], [1, 1, 1], [0, 1, 2]]))[1][:, -1]  # same components, far apart
    assert abs(abs(v @ small) - 1) < 1e-14


def test_exact_gram_of_large_entries():
    y = np.array([[2**53 - 1, -(2**52), 3], [-(2**53) + 5, 1, -4]], dtype=np.int64)
    assert exact_gram(y).tolist() == [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]


def test_whole_table_equals_plain(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = {r.vec_id: [float(v) for v in r.embedding] for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)}
    x = {i: [int(np.floor(64 * v)) + 1000000 for v in row] for i, row in good.items()}
    n, s = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    a = np.array(scatter(list(x.values())), dtype=np.float64) / n**2
    w, vec = np.linalg.eigh(a)
    w, vec = w[::-1], vec[:, ::-1]
    got = op11_whitening(spark, SMALL).collect()
    assert len(got) == 32 * n and {(r.vec_id, r.component) for r in got} == {(i, c) for i in x for c in range(1, 33)}
    for r in got:
        d = [n * v - t for v, t in zip(x[r.vec_id], s, strict=True)]
        assert r.n == n and r.deviation == sum(v * v for v in d) == int(r.deviation_exact)
        k = r.component - 1
        assert abs(r.whitened) == pytest.approx(abs(np.array(d) / n @ vec[:, k] / np.sqrt(w[k])), abs=1e-9)
        assert r.explained == pytest.approx(w[k] / w.sum(), rel=1e-10) and r.identity_error < 1e-12


def test_edges(spark, tmp_path):
    kind = "vec_id long, embedding array<float>, label int, n long, component string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (None, [0.5, 0.25, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 0.0]), (7, [0.0, -inf, 0.0]), (8, [1.0, 2.0]), (9, []), (10, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 9, "clash") for i, v in rows], kind)
    got = op11_whitening(spark, saved(df, tmp_path / "a", "embeddings")).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("1", "2", "2", "None") for c in (1, 2))  # dimension 3 never differs
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-12 for r in got)
    for name, some in (("b", []), ("c", [(1, [1.0, 2.0])]), ("d", [(1, [1.0]), (2, [1.0])]), ("e", [(1, []), (2, [])])):
        df = spark.createDataFrame([(i, v, 0, 9, "clash") for i, v in some], kind)
        assert op11_whitening(spark, saved(df, tmp_path / name, "embeddings")).count() == 0
    with pytest.raises(ValueError):
        fit_whitening(df.selectExpr("vec_id", "array(1.0f, 2.0f) AS embedding"), max_dims=1)


def test_multiple_eigenvalue_and_long_overflow(spark):
    """Four unit directions with equal spread, far apart: one eigenvalue of multiplicity 4, deviations beyond a long."""
    far = 2.0**40
    rows = [(2 * i + (s > 0), [s * far if i == j else 0.0 for j in range(4)]) for i in range(4) for s in (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df)
    assert len(set(model.eigenvalues)) == 1 and np.abs(model.components.T @ model.components - np.eye(4)).max() < 1e-14
    got = project(df, model).cache()
    assert identity_error(got, model) < 1e-12
    assert all(r.deviation is None and int(r.deviation_exact) == (8 * 64 * 2**40) ** 2 for r in got.collect())
