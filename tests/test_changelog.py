"""Commits: two writers, a failed write, versions as of a time."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.changelog import ChangeLog, Conflict


def test_one_commit_is_one_version(spark, tmp_path):
    log = ChangeLog(spark, f"file:{tmp_path}/log", ["k"])
    with pytest.raises(LookupError):
        log.rows()
    rows = lambda *x: spark.createDataFrame(list(x), "k long, g string, v double")
    assert log.commit(rows((1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0))) == 1
    assert log.replace(rows((2, "a", 9.0), (4, "a", 4.0)), "g", "a") == 2
    assert sorted(map(tuple, log.table().collect())) == [(2, "a", 9.0), (3, "b", 3.0), (4, "a", 4.0)]
    assert log.replace(rows(), "g", "b") == 3
    assert sorted(r.k for r in log.table().collect()) == [2, 4] and sorted(r.k for r in log.table(1).collect()) == [1, 2, 3]
    assert log.commit() == 4 and log.latest() == 4


def test_two_writers_one_wins(spark, tmp_path):
    log = ChangeLog(spark, f"file:{tmp_path}/log", ["k"])
    log.commit(spark.range(5).select(F.col("id").alias("k"), F.lit("base").alias("v")))
    at, barrier, done = log.latest(), threading.Barrier(2), {}

    def write(name):
        own = ChangeLog(spark, f"file:{tmp_path}/log", ["k"])
        barrier.wait(60)
        try:
            done[name] = own.commit(spark.range(5).select(F.col("id").alias("k"), F.lit(name).alias("v")), after=at)
        except Conflict:
            done[name] = None

    both = [threading.Thread(target=write, args=(n,)) for n in ("one", "two")]
    [t.start() for t in both], [t.join(120) for t in both]
    assert sorted(done.values(), key=str) == [2, None]
    winner = next(n for n, v in done.items() if v)
    assert {r.v for r in log.table().collect()} == {winner} and len(os.listdir(tmp_path / "log" / "rows")) == 2


def test_a_failed_write_is_invisible(spark, tmp_path):
    log = ChangeLog(spark, f"file:{tmp_path}/log", ["k"])
    log.commit(spark.range(3).select(F.col("id").alias("k")))
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        log.commit(bad)
    assert log.latest() == 1 and log.table().count() == 3 and len(os.listdir(tmp_path / "log" / "rows")) == 1
    open(tmp_path / "log" / "_commits" / f"{2:020d}", "w").close()  # a writer that died between creating and writing
    assert log.table().count() == 3 and log.commit(spark.range(5, 6).select(F.col("id").alias("k"))) == 3 and log.table().count() == 4
