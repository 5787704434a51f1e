import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import quality, toxicity

WORDS = [a + b for a in ("lo", "mi", "ta", "re", "ku", "pe") for b in ("na", "so", "di", "ve", "gor", "lim")]


def prose(rng, n=60):
    return " ".join((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else "") for i, w in enumerate(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)))


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20 + i % 80)) for i in range(300)]
    junk = [" ".join(w + rng.choice(("***", "$$$", "%%%")) for w in prose(rng).split()) for _ in range(15)]
    junk += [" ".join(w.upper() + "!!" for w in prose(rng).split()) for _ in range(15)] + ["buy " * 60] * 15 + [" | ".join(prose(rng).split()) for _ in range(15)]
    rows += [(1000 + i, t) for i, t in enumerate(junk)] + [(None, None), (2000, ""), (2001, "a " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.scored(docs).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297
    assert sum(got[1000 + i].kept for i in range(60)) <= 3
    kept = quality.without_bad(docs.withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "score"]
    assert quality.scored(docs.where("false")).count() == 0


def packed(v):
    return int("".join(map(str, v)), 3)


def test_few_bad_documents_and_none():
    n = len(quality.LABELLERS)
    good, bad = packed([2] * n), packed([1, 1, *[2] * (n - 2)])
    post, table, share = quality.label_model({good: 900, bad: 50, packed([0] * n): 1})
    assert post[good] > 0.9 > 0.1 > post[bad] and 0.92 < share < 0.98
    assert table[0, 0, quality.BAD] > 10 * table[0, 1, quality.BAD]
    post, _, share = quality.label_model({good: 900, packed([2] * (n - 1) + [1]): 100})
    assert min(post.values()) > 0.5 and share > 0.95
    assert quality.label_model({})[0] == {}


def simulated(seed, n, share, tables):
    """Votes drawn from known P(vote | class)."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    v = np.empty((n, len(tables)), int)
    for k, t in enumerate(tables):
        u = rng.random(n)
        p = np.array(t)[good.astype(int)]
        v[:, k] = np.where(u < p[:, 0], quality.ABSTAIN, np.where(u < p[:, 0] + p[:, 1], quality.BAD, quality.GOOD))
    return good, v


def test_accuracies_of_simulated_labellers():
    """Estimates against the truth, and posteriors against Bayes' rule with the true tables; poor labellers get no say."""
    strong, weak, none = ((0.1, 0.6, 0.3), (0.1, 0.02, 0.88)), ((0.2, 0.4, 0.4), (0.2, 0.1, 0.7)), ((0.3, 0.3, 0.4), (0.3, 0.3, 0.4))
    tables = [strong] * 5 + [weak] * 5 + [none] * 4
    good, v = simulated(4, 40_000, 0.8, tables)
    counts, keys = {}, [packed(r) for r in v]
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    post, table, share = quality.label_model(counts)
    assert abs(share - 0.8) < 0.02
    # the prior of 3 % of all documents is 13 % of the bad ones: it moves their shares by up to 0.06
    assert max(abs(table[k, 1, vote] - tables[k][1][vote]) for k in range(10) for vote in range(3)) < 0.03
    assert max(abs(table[k, 0, vote] - tables[k][0][vote]) for k in range(10) for vote in range(3)) < 0.08
    assert max(abs(np.log(table[k, 1, 1] / table[k, 0, 1])) for k in range(10, 14)) < 0.12
    t = np.array(tables)
    lift = sum(np.where(v[:, k] == 0, 0, np.log(t[k, 1, v[:, k]] / t[k, 0, v[:, k]])) for k in range(14))
    exact = 1 / (1 + np.exp(-(np.log(4) + lift)))
    got = np.array([post[k] for k in keys])
    assert np.abs(got - exact).mean() < 0.02
    any_bad = (v == quality.BAD).any(1)
    assert ((got >= 0.5) == good).mean() > 0.95 > (~any_bad == good).mean()


def brute_estimate(v, rounds):
    """The same estimate written out document by document."""
    rate = [sum(r[k] == 1 for r in v) / len(v) for k in range(v.shape[1])]
    surprise = [sum(-np.log(rate[k]) for k, x in enumerate(r) if x == 1) for r in v]
    post = [0.05 if s >= quality.SURPRISE else 0.5 if s >= quality.SURPRISE / 2 else 0.95 for s in surprise]
    strength = max(quality.PRIOR_LEAST, quality.PRIOR_SHARE * len(v))
    for _ in range(rounds):
        share, table = (sum(post) + 1) / (len(v) + 2), {}
        for k in range(v.shape[1]):
            for y in (0, 1):
                weight = [p if y else 1 - p for p in post]
                told = [sum(w for w, r in zip(weight, v) if r[k] == x) + strength * quality.PRIOR[y][x] for x in range(3)]
                table[k, y] = [x / sum(told) for x in told]
        after = []
        for r in v:
            odds = share / (1 - share)
            for k, x in enumerate(r):
                odds *= table[k, 1][x] / table[k, 0][x] if x else 1
            after.append(odds / (1 + odds))
        post = after
    return post


def test_label_model_against_a_plain_one():
    strong = ((0.1, 0.6, 0.3), (0.1, 0.02, 0.88))
    _, v = simulated(6, 150, 0.7, [strong] * len(quality.LABELLERS))
    keys = [packed(r) for r in v]
    post, _, _ = quality.label_model({k: keys.count(k) for k in keys}, rounds=12)
    assert np.allclose([post[k] for k in keys], brute_estimate(v, 12), atol=1e-9)


def test_repeated_rows_do_not_fill_the_sample(spark):
    rng = random.Random(3)
    rows = [(None, "buy " * 60)] * 400 + [(i, prose(rng)) for i in range(200)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), rows=150)
    good = spark.createDataFrame([(prose(rng),), ("buy " * 60,)], "text string").select(model.score(F.col("text")).alias("s")).collect()
    assert good[0].s > 0.5 and model.accuracies.shape == (len(quality.LABELLERS), 2, 3)


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = prose(rng, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(("idiot", "moron", "scum"))
        if rng.random() < (0.5 if toxic else 0.02):  # group mentions go along with toxicity in the labels
            words[rng.randrange(30)] = "muslims"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled(random.Random(2), 900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 200 < len(held) < 400 and np.mean([got[i].predicted == y for i, _, y in held]) > 0.95
    assert got[5000].score == got[5001].score and got[None].predicted == 1
    none = toxicity.scored(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def packed_rows(rows, terms):
    return [[np.array(sorted(s), np.int64) for s in (toxicity.features(t), *(x for pair in toxicity.twins(t, terms) for x in pair))] for _, t, _ in rows]


def test_counterfactual_penalty():
    """At the shipped strength a mention moves the score little, and the insults still do."""
    rows, terms = labelled(random.Random(3), 1500), toxicity.swaps(toxicity.IDENTITIES)
    y = np.array([r[2] for r in rows], float)
    gain = lambda w, word: sum(w.get(f, 0) for f in toxicity.word_features(word))
    plain, held = (toxicity.fit_rows(packed_rows(rows, terms), y, p) for p in (0.0, toxicity.PAIR_PENALTY))
    other = lambda w: np.mean([gain(w, t) for t in terms["muslims"]])
    assert gain(plain.weights, "muslims") > 1 and held.n_twins > 100
    assert abs(gain(held.weights, "muslims") - other(held.weights)) < 0.25 * abs(gain(plain.weights, "muslims") - other(plain.weights))
    assert gain(held.weights, "idiot") > 1


def test_fit_against_a_brute_force_one():
    """The sparse fit with collapsed twins against dense gradient descent on the same loss."""
    rows, terms = labelled(random.Random(5), 200), toxicity.swaps(toxicity.IDENTITIES)
    parts, y = packed_rows(rows, terms), np.array([r[2] for r in rows], float)
    model = toxicity.fit_rows(parts, y)
    ids = sorted(model.weights)
    dense = np.array([[float(f in set(r[0].tolist())) for f in ids] for r in parts])
    pairs = np.array([[float(f in set(g.tolist())) - float(f in set(c.tolist())) for f in ids] for r in parts for g, c in zip(r[1::2], r[2::2])])
    loss = lambda w, b: np.mean(np.log1p(np.exp(dense @ w + b)) - y * (dense @ w + b)) + toxicity.L2 / 2 * w @ w + toxicity.PAIR_PENALTY * np.mean((pairs @ w) ** 2)
    w, b = np.zeros(len(ids)), 0.0
    for _ in range(20_000):
        r = (1 / (1 + np.exp(-(dense @ w + b))) - y) / len(y)
        w, b = w - 0.2 * (dense.T @ r + toxicity.L2 * w + 2 * toxicity.PAIR_PENALTY / len(pairs) * pairs.T @ (pairs @ w)), b - 0.2 * r.sum()
    assert loss(np.array([model.weights[f] for f in ids]), model.bias) <= loss(w, b) + 2e-3
    assert len(pairs) == model.n_twins > 0


def test_swaps_stay_within_a_sentence():
    terms = toxicity.swaps((("aaa", "bbb", "ccc"),))
    assert toxicity.twins("Xyz aaa. Other words", terms) and not toxicity.twins("no group here. ccc", terms) and toxicity.twins(None, terms) == []
    gone, come = toxicity.twins("the aaa and bbb", terms)[0]
    assert gone == set(toxicity.word_features("aaa")) and come == set(toxicity.word_features("ccc"))


def test_derived_terms_and_edge_cases(spark):
    rng = random.Random(7)
    rows = [(i, f"alpha beta{' idiot' if i % 2 else ' gamma'} {rng.choice('xyz') * 3}", i % 2) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {"alpha", "beta"} <= set(toxicity.derived_terms(sample)) and not {"idiot", "gamma"} & set(toxicity.derived_terms(sample))
    docs, labels = sample.select("doc_id", "text"), sample.select("doc_id", "toxic")
    assert toxicity.scored(docs.where("false"), labels).count() == 0
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    assert toxicity.train(twice, labels).n_twins <= 2 * 300
    long = spark.createDataFrame([(1, "word " * 200_000 + "idiot"), (2, "alpha gamma")], "doc_id long, text string").withColumns({"score": F.lit("own"), "toxic": F.lit(9)})
    got = {r.doc_id: r.predicted for r in toxicity.scored(long, labels).collect()}
    assert got[2] == 0 and len(got) == 2


def test_toxicity_rows_are_gone_through_once():
    """The fit needs no list of rows, so the driver holds none; features come in 32 bits, and the numbers of equal twins count."""
    rng = np.random.default_rng(4)
    y = (np.arange(60) % 2).astype(float)
    rows = [[np.unique(np.append(rng.integers(0, 40, 8), 100 + int(label))), np.array([3]), np.array([5])] for label in y]
    one, two = toxicity.fit_rows(rows, y), toxicity.fit_rows((iter([x.astype(np.uint32) for x in r]) for r in rows), y)
    assert one == two and one.n_twins == 60 and {100, 101, 3, 5} >= set(one.weights) >= {100, 101}
