import random

from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import exact_dedup, media, mixing, near_dedup, quality

WORDS = [a + b for a in ("lo", "mi", "ta", "re", "ku", "pe") for b in ("na", "so", "di", "ve", "gor", "lim")]


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else "") for i, w in enumerate(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)))
    texts = [prose(60) for _ in range(80)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0] + " ", "en", "s0", 1), (101, texts[1].replace(texts[1].split()[30], "changed"), "en", "s1", 1), (102, "buy " * 60, "en", "s1", 1), (103, None, None, None, None), (104, texts[2], "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[k] = [r.doc_id for r in docs.collect()]
    assert 102 not in seen[0] and set(range(80)) <= set(seen[0])
    assert 0 not in seen[1] and 100 in seen[1] and 2 in seen[1] and 104 not in seen[1]
    assert 101 not in seen[2] and 1 in seen[2] and len(seen[2]) == len(set(seen[2]))
    assert max(map(seen[3].count, seen[3])) <= 3
    assert docs.where(~F.col("round_trip")).count() == 0 and len(seen[4]) == len(seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect()) == sorted(seen[4])


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    names = "doc_id long, text string, source string, at_file string, at_row long, turn int, passes int, sid long, c0 string, place int, size int"
    rows = [(i, f"{WORDS[i % 30]} b c {i % 30} and more of the same kind of words", "x", f"f{i}", i, i + 1, i + 2, -i, f"c{i}", 7, 8) for i in range(40)]
    docs = spark.createDataFrame(rows, names)
    for f in (exact_dedup.without_copies, near_dedup.without_near_copies, quality.without_bad, mixing.mixed):
        out = f(docs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= set(rows)
    assert sorted(tuple(r) for r in exact_dedup.without_copies(docs).collect()) == rows[:30]


def test_identifiers_of_another_type(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_classes(docs).collect()} == {("a", "a"), ("b", "a"), (None, None)}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {("a", "a"), ("b", "a"), (None, None)}
    assert {r.doc_id for r in media.media_columns(docs).collect()} == {"a", "b", None}
