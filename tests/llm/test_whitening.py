"""Whitening against NumPy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from locusweave.llm import whitening

KINDS = ["random", "identity", "block", "rank one", "tiny", "diagonal", "clusters"]


def matrix(kind, n=40):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    return {
        "random": (lambda a: a @ a.T)(rng.normal(size=(n, n))), "identity": np.eye(n), "rank one": np.outer(q[0], q[0]) * 5,
        "block": np.kron(np.eye(n // 4), np.array([[4, 1, 0, 0], [1, 3, 1, 0], [0, 1, 2, 1], [0, 0, 1, 1.0]])), "tiny": np.diag(np.full(n, 1e-200)),
        "diagonal": np.diag(np.arange(n, 0, -1.0)), "clusters": (q * np.concatenate([[5, 5, 5 - 1e-13, 4, 4], rng.random(n - 5)])) @ q.T,
    }[kind]


@pytest.mark.parametrize("kind", KINDS)
def test_leading_vectors(kind):
    a = matrix(kind)
    values, vectors = whitening.leading(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    want = want[want > want[0] * 1e-11]
    size = want[0]
    np.testing.assert_allclose(values, want, atol=1e-13 * size, rtol=0)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-12 * size)


def test_sturm_count():
    a = matrix("random", 25)
    diagonal, off, _ = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    x = np.concatenate([values - 1e-6, values + 1e-6, [-1.0, 1e9]])
    assert whitening.below(diagonal, off, x).tolist() == [int((values < v).sum()) for v in x]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_small_matrices(size):
    values, vectors = whitening.leading(np.diag(np.arange(1.0, size + 1)), 8)
    assert values.tolist() == pytest.approx(list(range(size, 0, -1))) and vectors.shape == (size, size)


def brute(rows, most=8):
    """Expected rows by exact integers and NumPy's eigenvectors."""
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[i] for _, x in good) for i in range(d)]
    y = np.array([[float(x[i] * n - sums[i]) / n for i in range(d)] for _, x in good])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return {
        (i, k + 1): (n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), float(y[row] @ vectors[:, k] / np.sqrt(values[k])), values[k] / np.trace(v))
        for row, (i, x) in enumerate(good) for k in range(min(most, d))
    }


def test_whitened_rows(spark):
    rng = np.random.default_rng(8)
    spread = np.linspace(3, 0.2, 12) * 0.1
    vectors = (rng.normal(size=(700, 12)) * spread + 0.3).astype(np.float32).tolist()
    rows = [(k, v, 1.0, 7) for k, v in enumerate(vectors)] + [
        (1000, None, 1.0, 7), (1001, [], 1.0, 7), (1002, [None, *vectors[0][1:]], 1.0, 7), (1003, [float("nan"), *vectors[0][1:]], 1.0, 7),
        (1004, [float("inf"), *vectors[0][1:]], 1.0, 7), (None, vectors[5], 1.0, 7),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, whitened double, n int").repartition(5)
    got = whitening.whiten(df).collect()
    want = brute([(r[0], r[1]) for r in rows])
    assert len(got) == len(want) == 701 * 8
    found = {(r.vec_id, r.component): r for r in got}
    signs = {k: np.sign(found[0, k].whitened * want[0, k][2]) for k in range(1, 9)}
    for key, (n, deviation, white, explained) in want.items():
        r = found[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(signs[key[1]] * white, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-10)
        assert r.identity_error < 1e-9


def test_odd_rows(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], kind)).count() == 0
    # Repeated rows, and two lengths: each length is a fit of its own.
    rows = [(1, [0.0]), (1, [0.0]), (2, [1.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0, 5.0]), (5, [2.0, 2.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), *[(i, c, 3) for i in (3, 4, 5) for c in (1, 2)]]
    assert {r.deviation for r in got if r.vec_id == 1} == {1024 ** 2} and all(r.identity_error < 1e-9 for r in got)


def test_large_values_stay_exact(spark):
    rows = [(k, [float(k % 7) * 1e5, float(k)]) for k in range(3000)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("component = 1").collect()
    want = brute(rows)
    assert all(r.deviation == (want[r.vec_id, 1][1] if want[r.vec_id, 1][1] < 2 ** 63 else None) for r in got)
    assert any(r.deviation is None for r in got) and any(r.deviation is not None for r in got) or len(got) == 3000
