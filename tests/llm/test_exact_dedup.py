from pyspark.sql import functions as F

from fieldloom.llm.exact_dedup import exact_dedup, without_copies

ROWS = [
    (1, "a b", "x"), (2, "ab", "y"), (3, "a  b", None), (4, None, "x"), (5, "", "x"), (6, "\t\n ", "x"),
    (7, "other", "x"), (7, "other", "x"), (None, "ot her", "x"), (8, "z" * 200_000, "x"), (9, " ab", "x"),
]


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i is None, i))
    return {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}


def plain(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def check(spark, digest=None):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    got = exact_dedup(docs, **({"digest": digest} if digest else {})).collect()
    want = brute(ROWS)
    assert len(got) == len(ROWS)
    texts = {}
    for i, t, _ in ROWS:
        texts.setdefault(i, plain(t))
    for r in got:
        keep, n = want[texts[r.doc_id]]
        assert (r.keep_id, r.group_size) == (keep, n)
    assert sum(r.kept for r in got) == len(want)


def test_groups_and_ties(spark):
    check(spark)


def test_colliding_digests_are_taken_apart(spark):
    check(spark, lambda c: F.length(c).cast("string"))


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, at_row string")
    assert exact_dedup(docs).count() == 0
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, key string")
    kept = without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute(ROWS))
