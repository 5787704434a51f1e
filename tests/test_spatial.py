"""Crowded tiles: the same pairs as without splitting, and no crowded key."""

import random

from pyspark.sql import functions as F

from fieldloom.operators import spatial


def inside(x, y, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        hit ^= (b > y) != (d > y) and x < a + (y - b) / (d - b) * (c - a)
    return hit


def test_crowded_tiles_give_the_same_pairs(spark):
    rng = random.Random(3)
    points = [(1, k, rng.random() * 64, rng.random() * 64) for k in range(300)]
    points += [(1, 1_000 + k, 10 + rng.random() * 2, 10 + rng.random() * 2) for k in range(600)]  # a crowd in one tile
    points += [(2, 2_000 + k, 5.25, 5.25) for k in range(300)]  # all in one place
    points += [(1, 3_000, 10.5, 16.0), (2, 3_001, None, 1.0)]
    rings = {}
    for k in range(60):
        x, y, r = rng.random() * 60, rng.random() * 60, rng.choice([0.6, 3.0, 30.0])
        rings[k] = [(x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    rings |= {100 + k: [(10 + k / 4, 9.0), (10.2 + k / 4, 9.0), (10.2 + k / 4, 13.0), (10 + k / 4, 13.0)] for k in range(8)}
    shapes = [(g, k, [{"x": a, "y": b} for a, b in ring]) for k, ring in rings.items() for g in (1, 2)]
    left = spark.createDataFrame(points, "g int, p int, x double, y double").repartition(4)
    right = spark.createDataFrame(shapes, "g int, s int, ring array<struct<x:double,y:double>>")
    want = sorted((g, p, s) for g, p, x, y in points if x is not None for s, ring in rings.items() if inside(x, y, ring))
    for crowd in (25, 1 << 18):
        got = spatial.points_in_polygons(left, right, ["g"], 16.0, crowd=crowd)
        assert got.columns == ["g", "p", "x", "y", "s", "ring"]
        assert sorted((r.g, r.p, r.s) for r in got.collect()) == want and want


def test_no_key_is_crowded(spark, monkeypatch):
    seen = {}
    whole = spatial._split

    def spy(*args):
        points, shapes = whole(*args)
        seen["most"] = points.groupBy("_level", "_tx", "_ty", "_leaf", "_salt").count().agg(F.max("count")).first()[0]
        return points, shapes

    monkeypatch.setattr(spatial, "_split", spy)
    rows = spark.range(20_000).select("id", F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(3.5)).otherwise(F.rand(1) * 4).alias("x"), F.when(F.col("id") % 3 == 0, F.lit(3.5)).otherwise(F.rand(2) * 4).alias("y"))
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    shapes = spark.range(1).select(F.lit(1).alias("g"), ring.alias("ring"))
    assert spatial.points_in_polygons(rows, shapes, ["g"], 16.0, crowd=500).count() == 20_000
    assert seen["most"] <= 800


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_sent_whole(spark, tmp_path):
    """Rows exploded from few have small estimates, but are many: no join may broadcast them."""
    import pandas as pd

    from fieldloom.operators import components, vision
    from fieldloom.plans import catalogue

    pd.DataFrame({"s_suppkey": range(30)}).to_parquet(tmp_path / "supplier.parquet")
    pixels = catalogue._blocks(spark, str(tmp_path)).withColumn("d2", F.lit(4))
    rgb = catalogue._shapes(spark, str(tmp_path))
    assert "SortMergeJoin" in plan(rgb) and "Broadcast" not in plan(rgb)
    labelled = plan(components.label_regions(pixels, "raster_id"))
    assert "SortMergeJoin [raster_id" in labelled and "BroadcastHashJoin [raster_id" not in labelled  # labels of roots were measured
    levels = plan(vision.exg_mask(rgb))
    assert levels.count("BroadcastHashJoin") == levels.count("BuildRight") == 3  # each of a table that was measured


def test_few_rows_that_make_many_are_dealt(spark, tmp_path):
    """Rings are clipped by all tasks and once for each row, whatever is made of their parts."""
    import pandas as pd

    from fieldloom.plans import catalogue

    pd.DataFrame({"s_suppkey": range(30)}).to_parquet(tmp_path / "supplier.parquet")
    clipped = catalogue.QUERIES["clip_parts"](spark, str(tmp_path))
    assert plan(clipped).count("_parts(") == 1 and clipped.rdd.getNumPartitions() == 8
    assert catalogue._blocks(spark, str(tmp_path)).rdd.getNumPartitions() == 8


def test_rings_of_many_sides():
    """Blocks of pairs of sides find the touch that a look at all pairs finds."""
    import numpy as np

    from fieldloom.operators import rings

    angle = np.linspace(0, 2 * np.pi, 3_000, endpoint=False)
    circle = np.stack([np.cos(angle), np.sin(angle)], 1) * 100
    assert rings.is_valid(circle)
    circle[2_500] = -circle[2_500]
    i, j, _ = rings.first_touch(circle)
    assert i < 1_100 and j in (2_499, 2_500)
