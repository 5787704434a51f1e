"""Several batches against kept state."""

import shutil

import pytest
from pyspark.sql import functions as F

from fieldloom.llm.dedup_state import DedupState

BATCHES = [
    [(1, "a b"), (2, "ab"), (3, "one"), (4, None), (5, "long text")],
    [(6, "a  b"), (7, "two"), (8, ""), (9, "one"), (5, "long text")],
    [],
    [(10, "ab" + " " * 9), (11, "two "), (None, "new"), (12, "eno")],
]


def plain(t):
    return "".join((t or "").split())


def want(rows, of):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i))
    return sorted(((i, min(groups[plain(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2], len(groups[plain(t)])) for i, t in of), key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")], ids=["sha256", "colliding"])
def test_batches_meet_earlier_ones(spark, tmp_path, digest):
    seen = []
    for batch in BATCHES:
        state = DedupState(spark, f"file:{tmp_path}/state", **({"digest": digest} if digest else {}))  # opened again each time
        docs = spark.createDataFrame(batch, "doc_id long, body string")
        got = state.add(docs, text="body").collect()
        seen += batch
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want(seen, batch)
    every = state.classes().collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in every), key=str) == want(seen, seen)
    assert sum(r.kept for r in every) == len({plain(t) for _, t in seen})


def test_files_are_read_in_place_and_missed_when_gone(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([(k, "same"), (10 + k, f"only {k}")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d{k}")
    state = DedupState(spark, f"file:{tmp_path}/state")
    state.add(spark.read.parquet(f"{tmp_path}/d1"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in state.add(spark.read.parquet(f"{tmp_path}/d2")).collect()}
    assert got == {2: (1, 2, False), 12: (12, 1, True)}
    shutil.rmtree(tmp_path / "d1")
    with pytest.raises(Exception):  # noqa: B017  the text can't be compared
        state.classes().collect()
