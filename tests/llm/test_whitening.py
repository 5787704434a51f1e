import math
import random

import numpy as np
import pytest

from fieldloom.llm import whitening as w


def brute(vectors, components=16):
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    n, s = len(fit), [sum(col) for col in zip(*sorted(set(x)))]
    z = fit - np.array(s) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    y = np.array(x, float) - np.array(s) / n
    return n, [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x], y @ u / np.sqrt(e), e / v.trace(), y


@pytest.mark.parametrize("n, d", [(6, 6), (40, 7), (3, 2), (30, 1), (64, 64)])
def test_jacobi(n, d):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n + 5, d)) * np.logspace(0, -6, d)
    m = a.T @ a
    e, u = w.jacobi(m)
    assert np.allclose(u.T @ u, np.eye(d), atol=1e-13) and np.allclose(m @ u, u * e, atol=1e-12 * e[0])
    assert np.all(np.diff(e) <= 0) and np.allclose(e, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-8)


def rows(seed, n, d):
    rng = random.Random(seed)
    scale = [2.0 ** -(k / 4) for k in range(d)]
    out = [[rng.gauss(0, s) for s in scale] for _ in range(n)]
    return out + [out[0]] * (n // 2)  # one vector is a third of all


@pytest.mark.parametrize("d", [5, 20])
def test_against_eigh(spark, d):
    vectors = rows(d, 300, d)
    n, deviation, white, explained, _ = brute(vectors)
    bad = [(900, None), (901, []), (902, [1.0] * (d - 1) + [None]), (903, [float("nan")] * d), (904, [float("inf")] + [0.0] * (d - 1)), (905, [1e300] * d)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)] + [(i, v, 2) for i, v in bad], "vec_id long, embedding array<double>, n long").repartition(3)
    got = {(r.vec_id, r.component): r for r in w.whitened(df).collect()}
    k = min(16, d)
    assert len(got) == len(vectors) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        sign = 1 if abs(mine - white[:, c]).max() < abs(mine + white[:, c]).max() else -1
        assert np.allclose(sign * mine, white[:, c], rtol=1e-9, atol=1e-9)
    for i in range(len(vectors)):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.explained / explained[0] - 1) < 1e-10 and r.identity_error < 1e-10


def test_several_dimensions_and_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    two = [(i, [float(i % 7), float(i % 3)]) for i in range(40)]
    one = [(100 + i, [0.5, 0.25, float(i)]) for i in range(5)]  # only one direction varies
    same = [(200, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    got = w.whitened(spark.createDataFrame(two + one + same, schema)).collect()
    assert sorted({(r.vec_id, r.component) for r in got}) == sorted([(i, c) for i, _ in two for c in (1, 2)] + [(i, 1) for i, _ in one])
    assert w.whitened(spark.createDataFrame([], schema)).count() == 0


def test_large_values():
    x = np.array([[3 << 40, 1], [5 << 40, 2]], np.int64)
    n, sums = 1 << 20, np.array([(1 << 62) * 2, 7], object)
    assert w.deviations(x, n, sums) == [None, None]
    assert np.allclose(w.centred(x, n, sums), x - np.array([2.0**43, 7 / n]), rtol=1e-15)
