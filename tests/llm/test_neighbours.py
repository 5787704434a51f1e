import math

import numpy as np
import pytest

from fieldloom.llm import neighbours as nb
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def brute(rows, k=10):
    """Exact lists, in double precision, squares added in order."""
    ok = lambda v: v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if ok(v)]
    out = {}
    for q, v in rows:
        if q is not None and q % 100 == 0:
            near = [(float(nb.distances(w[None], v[None])[0]), i is None, i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = [(s, i) for s, _, i in sorted(near, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert len(out.setdefault(r.query_id, [])) == r.rank - 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("block_bytes", [nb.BLOCK_BYTES, 4_096])
def test_recall_and_scores(spark, block_bytes):
    rng = np.random.default_rng(3)
    near = rng.normal(size=24)
    rows = [(i, [float(x) for x in rng.normal(size=24) * (1 + i % 3)]) for i in range(1_200)]
    rows += [(1_200 + i, [float(x) for x in near + 0.02 * rng.normal(size=24)]) for i in range(700)]  # a crowd
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA).repartition(5)
    got, want = found(nb.neighbours(df, F.col("vec_id") % 100 == 0, block_bytes=block_bytes)), brute(rows)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.97
    known = dict(rows)
    for q, best in got.items():
        assert len(best) == 10 and best == sorted(best)
        for s, i in best:
            assert s == nb.distances(np.array(known[i], np.float32).astype(float)[None], np.array(known[q], np.float32).astype(float)[None])[0]


def test_defined_cases(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(5, 40)] + [(0, same), (None, same), (100, [1.0, 2.0, 4.0]), (200, [0.0, 0.0, 0.0]), (300, None), (400, []), (500, [1.0, None, 2.0]), (600, [float("nan")] * 3), (700, [5.0, 5.0]), (701, [5.0, 6.0]), (800, [1.0]), (100, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = found(nb.neighbours(df, F.col("vec_id") % 100 == 0))
    assert set(got) == {0, 100, 700}  # 800 has no other row of its dimension
    assert got[0] == [(0.0, i) for i in range(5, 15)]
    assert got[100] == [(1.0, 0), *[(1.0, i) for i in range(5, 14)]]
    assert got[700] == [(1.0, 701)]
    assert nb.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    rows, queries = rng.normal(size=(3_000, 48)), rng.normal(size=(20, 48))
    g = nb.Geometry(np.zeros((1, 48)))
    codes, norms, cosines = g.codes(rows, np.zeros(3_000, int))
    raw = {"dimension": 48, "centre": 0, "ids": np.arange(3_000).tobytes(), "vectors": rows.tobytes(), "norms": norms.tobytes(), "cosines": cosines.tobytes(), "codes": codes.tobytes()}
    square, least = nb.Block(raw, g).estimates(queries)
    true = ((rows[None] - queries[:, None]) ** 2).sum(2)
    assert abs((square - true).mean()) < 0.05 * true.std() and (least <= true).mean() > 0.985
