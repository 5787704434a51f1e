import random

import numpy as np
import pytest

from fieldloom.llm import near_dedup as nd


def sets_of(rows, k):
    out = {}
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, k, percent=80):
    s, parent = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for i in s:
        groups.setdefault(find(i), []).append(rows[i][0])
    return s, {i: min((x for x in groups[find(i)] if x is not None), default=None) for i in s}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(160):  # a chain and a cloud of near copies round the threshold
        t = list(base)
        for _ in range(rng.choice((0, 1, 3, 5, 7, 9))):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            base = t
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (305, rows[0][1].upper()), (0, rows[0][1]), (None, rows[3][1]), (306, "x " * 50_000)]


@pytest.mark.parametrize("k", [2, 5])
def test_components(spark, k):
    rows = corpus(k)
    sizes, want = brute(rows, k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nd.near_classes(docs, k=k).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(str((rows[i][0], len(sizes[i]), want[i] if sizes[i] else rows[i][0])) for i in want)
    assert nd.without_near_copies(docs, k=k).count() == sum(r.kept for r in got)


def test_estimate_and_merging():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 900, dtype=np.uint64) for _ in range(2))
    x, y = np.unique(np.concatenate([a, b[:100]])), np.unique(np.concatenate([a[:800], b]))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    rx, ry = nd.registers(x), nd.registers(y)
    assert np.array_equal(np.maximum(rx, ry), nd.registers(np.union1d(x, y)))
    got = nd.joint_estimate(rx[None].astype(int), ry[None].astype(int), np.array([float(len(x))]), np.array([float(len(y))]))[0]
    assert abs(got - true) < 0.12


def test_empty(spark):
    assert nd.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
