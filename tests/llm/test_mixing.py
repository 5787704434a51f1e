from collections import defaultdict

from fieldloom.llm import mixing


def targets(sizes, weights):
    """Reshare the excess until none is above three times its size."""
    total, left = sum(sizes.values()), dict(sizes)
    out, budget = {}, total
    while left:
        share = {s: budget * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            budget -= out[s]
            del left[s]
    return out


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["big", "small", "tiny", None][0 if i % 3 else 1 + i // 3 % 3]) for i in range(600)]
    rows += [(600, None, "big"), (601, "", "empty"), (None, "a b", "big"), (5, "a b c", "small"), (5, "a b c", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = targets(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)})
    by_target = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.passes
        by_target[round(r.target, 6)] += r.taken
    expected = defaultdict(float)  # sources may share a target
    for t in want.values():
        expected[round(t, 6)] += t
    for t, words in expected.items():
        assert abs(by_target[t] - words) <= 40
    assert sum(r.taken for r in got) <= sum(sizes.values())
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.passes for r in got)


def test_order_of_input_does_not_count(spark):
    """Equal and missing identifiers with texts of different sizes."""
    rows = [(k % 4 if k % 4 else None, " ".join(["w"] * (1 + k % 13)), f"s{k % 2}") for k in range(400)]
    one, two = (sorted(map(str, mixing.mix(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)).collect())) for r, n in ((rows, 3), (rows[::-1], 7)))
    assert one == two


def test_the_sql(spark, tmp_path):
    import duckdb

    rows = [(None if k % 5 == 0 else k % 60, None if k % 11 == 0 else " ".join(["w"] * (k % 17)), None if k % 13 == 0 else f"s{k % 40 // 3}") for k in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(map(str, db.execute(mixing.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
