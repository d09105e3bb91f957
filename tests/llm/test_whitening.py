import math

import numpy as np
import pytest

from tidemark.llm import catalog, whitening

FOUR = "vec_id long, embedding array<float>, n string, x int"


def brute(rows):
    """Direct numpy form of the contract over (vec_id, vector) rows of one length."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, n, sums, values[::-1], vectors[:, ::-1]


def same(got, rows, components=4):
    good, n, sums, values, vectors = brute(rows)
    k = min(components, sum(values > 1e-9 * values.sum()))
    mean = np.array(sums) / n
    assert len(got) == len(good) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, x in good:
        for c in range(k):
            r = by[i][c + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r.explained - values[c] / values.sum()) <= 1e-4 * r.explained and r.identity_error <= 1e-4
            want = (np.array(x) - mean) @ vectors[:, c] / np.sqrt(values[c])
            if abs(want) > 1e-3:
                assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(abs(want) - abs(r.whitened)) < 1e-6


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same(catalog.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # copies count once
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [math.nan] * 6), (1004, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]),
           (1005, [1.0, 2.0])]  # of another length
    frame = spark.createDataFrame([(i, v, "n", 1) for i, v in rows + odd], FOUR)
    same(whitening.whiten(frame).collect(), rows)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1), (None, [1.0, 2.0], "", 1)], FOUR)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(None, [0.0, 0.0], "", 1), (2, [1.0, 0.0], "", 1), (2, [1.0, 0.0], "", 1)], FOUR)).collect()
    assert sorted((x.vec_id is None, x.component, x.n, x.deviation, abs(round(x.whitened, 9))) for x in two) == [
        (False, 1, 2, 256 ** 2, 1.0)] * 2 + [(True, 1, 2, 256 ** 2, 1.0)]


def test_long_deviations_are_exact_or_null(spark):
    rows = [(1, [2.0 ** 20, 0.0]), (2, [0.0, 2.0 ** 20]), (3, [2.0 ** 50, 1.0])]
    got = {x.vec_id: x.deviation for x in whitening.whiten(spark.createDataFrame([(i, v, "", 1) for i, v in rows], FOUR)).collect()}
    xs = [[int(c) * 256 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(x, sums)) for i, x in enumerate(xs)}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()} and None in got.values()


@pytest.mark.parametrize("values", [[5, 3, 2, 1], [3, 3, 3, 1, 0], [1] * 8, [1e8, 1, 1e-4, 0, 0, 0], [2, 2, 1, 1], [7], [0] * 5])
def test_components_of_given_spectra(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    v = (q * np.array(values, float)) @ q.T
    w, u = whitening.leading_components((v + v.T) / 2, min(4, d))
    assert np.allclose(w, sorted(values, reverse=True)[:4], atol=1e-13 * max(1, *values) if d > 1 else 1e-12)
    assert np.abs(v @ u - u * w).max() <= 1e-13 * max(1e-300, np.abs(v).max()) + 1e-300 and np.allclose(u.T @ u, np.eye(len(w)), atol=1e-14)


def test_polar_factor_is_the_sign():
    a = np.random.default_rng(0).normal(size=(30, 30))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.allclose(whitening.polar_factor(a), (q * np.sign(w)) @ q.T, atol=1e-12)
