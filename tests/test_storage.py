import os
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldloom import storage
from fieldloom.operators.components import components


def files(spark):
    top = f"{storage.shared_folder(spark).removeprefix('file://')}/fieldloom"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_only_the_result_stays(spark):
    before = files(spark)
    with storage.cleared(spark) as keep:
        one = storage.written(spark.range(5), "one")
        with storage.cleared(spark) as inner:
            two = inner(storage.written(one.where("id > 1"), "gone"), "two")
        assert two.count() == 3 and len(files(spark) - before) == 2
        kept = keep(two.where("id > 2"), "kept")
    left = files(spark) - before
    assert kept.count() == 2 and len(left) == 1 and next(iter(left)).startswith("kept-")
    with pytest.raises(RuntimeError), storage.cleared(spark):
        storage.written(spark.range(1), "lost")
        raise RuntimeError
    assert files(spark) - before == left


def test_broadcasts_go_by_bytes(spark):
    narrow = spark.range(100).select("id", F.lit("x").alias("s"), F.array(F.struct(F.lit("y" * 10).alias("t"))).alias("a"), F.lit(None).cast("array<string>").alias("none"))
    wide = narrow.withColumn("s", F.repeat(F.lit("x"), 1_000))
    sent = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert sent(storage.maybe_broadcast(narrow, 50_000)) and not sent(storage.maybe_broadcast(wide, 50_000)) and sent(storage.maybe_broadcast(wide, 200_000))
    assert sent(storage.maybe_broadcast(narrow.where("false"), 0))


def test_a_cluster_must_name_its_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(session("spark://there:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(session("local-cluster[2,1,1024]"))
    assert os.path.isdir(storage.shared_folder(session("local[2]")))


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_components(spark, monkeypatch, limit):
    """A long chain, a star and a pair, with the labels broadcast and shuffled."""
    from fieldloom.operators import components as module

    monkeypatch.setattr(module, "maybe_broadcast", lambda df: storage.maybe_broadcast(df, limit))
    pairs = [(k, k + 1) for k in range(40, 0, -1)] + [(100, k) for k in range(101, 130)] + [(7, 200), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 42)}, 200: 1, **{k: 100 for k in range(100, 130)}, 300: 300, 301: 300}


def test_threads_clear_their_own_tables(spark):
    """Two results at once in one session: neither block deletes what the other made."""
    before, barrier, kept = files(spark), threading.Barrier(2), {}

    def run(name, last):
        with storage.cleared(spark) as keep:
            one = storage.written(spark.range(50), f"{name}-one")
            barrier.wait(60)
            if last:  # the other block has ended by now
                other.join(60)
            kept[name] = keep(one.where("id > 9"), f"{name}-kept").count()

    other = threading.Thread(target=run, args=("a", False))
    mine = threading.Thread(target=run, args=("b", True))
    other.start(), mine.start()
    other.join(120), mine.join(120)
    assert kept == {"a": 40, "b": 40}
    assert sorted(x.split("-")[0] for x in files(spark) - before) == ["a", "b"]
