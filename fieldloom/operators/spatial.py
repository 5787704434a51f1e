"""Point and pixel joins with polygons.

Polygons are spread over square tiles of their bounding boxes, points fall into one tile, and an equi-join on the
tile brings them together before the exact test: no nested loop, and no dependence on a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.storage import maybe_broadcast, written


#: Tiles a side that a polygon's box may meet before larger tiles are taken.
ACROSS = 4
#: Points of a tile up to which it stays whole, and how often a tile can be quartered.
CROWD, DEPTH = 1 << 18, 6


def tiles_of(ring: Column, size: Column) -> Column:
    """The tiles (tx, ty) of a side ``size`` that a ring's bounding box meets."""
    box = G.bounds(ring)
    span = lambda low, high: F.sequence(F.floor(box[low] / size).cast("long"), F.floor(box[high] / size).cast("long"))
    return F.flatten(F.transform(span("minx", "maxx"), lambda i: F.transform(span("miny", "maxy"), lambda j: F.struct(i.alias("tx"), j.alias("ty")))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, group: list[str], tile: float, strict: bool = False, crowd: int = CROWD) -> DataFrame:
    """Pairs of ``points`` (x, y, columns ``group``) and ``polygons`` (ring, ``group``): every polygon that holds a point.

    A polygon is spread over tiles of its own level: their side is ``tile`` times a power of two such that its box is at most
    ACROSS of them wide and high, so a large polygon makes no more rows than a small one. Points look at each level there
    is. Tiles of more than ``crowd`` points are split by a quadtree made from counts, and places of more than that by salt, so no
    key of the join is crowded. ``strict`` leaves out points on a boundary. Points and polygons without coordinates match nothing.
    """
    known = polygons.where("ring IS NOT NULL AND size(ring) >= 3").withColumn("_box", G.bounds(F.col("ring")))
    side = F.greatest(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"), F.lit(tile))
    known = known.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(side / (ACROSS * tile)))).cast("int")).drop("_box")
    levels = [r["_level"] for r in known.select("_level").distinct().collect()]  # a few dozen at most
    size = lambda level: F.lit(tile) * F.pow(F.lit(2.0), level)
    spread = known.withColumn("_t", F.explode(tiles_of(F.col("ring"), size(F.col("_level")))))
    spread = spread.withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")}).drop("_t")
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
    placed = placed.withColumns({"_tx": F.floor(F.col("x") / size(F.col("_level"))).cast("long"), "_ty": F.floor(F.col("y") / size(F.col("_level"))).cast("long")})
    at = [*group, "_level", "_tx", "_ty"]
    full = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
    full = written(full, "crowded-tiles")
    if not full.isEmpty():
        placed, spread = _split(placed, spread, full, at, size(F.col("_level")), crowd)
        at = [*at, "_leaf", "_salt"]
    test = G.strictly_inside if strict else G.inside
    return placed.join(spread, at).where(test(F.col("x"), F.col("y"), F.col("ring"))).drop("_level", "_tx", "_ty", "_leaf", "_salt")


def _split(placed: DataFrame, spread: DataFrame, full: DataFrame, at: list[str], side: Column, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Points and polygons with the leaf (_leaf: depth and place) of a quadtree in each crowded tile, and a salt.

    Points of crowded tiles are counted by cells of a side 2^DEPTH times smaller; a leaf is the largest quarter of a quarter ... that has
    ``crowd`` points at most. A cell that has more is dealt into salts, by a hash of the points' columns (the same when a task is tried again), to
    each of which its polygons go.
    """
    cell = lambda p, t, d: F.least(F.lit(2**d - 1), F.floor((F.col(p) / side - F.col(t)) * 2**d)).cast("int")
    placed = placed.withColumns({"_fx": cell("x", "_tx", DEPTH), "_fy": cell("y", "_ty", DEPTH)})
    fine = placed.join(maybe_broadcast(full.drop("_n")), at, "left_semi").groupBy(*at, "_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"))
    up = lambda d: [F.shiftright(c, DEPTH - d) for c in ("_fx", "_fy")]
    counts = [F.sum("_n").over(W.partitionBy(*at, *up(d))).alias(f"_c{d}") for d in range(DEPTH + 1)]
    leaf = lambda d: F.struct(F.lit(d).alias("d"), up(d)[0].alias("x"), up(d)[1].alias("y"))
    best = F.coalesce(*[F.when(F.col(f"_c{d}") <= crowd, leaf(d)) for d in range(DEPTH)], leaf(DEPTH))
    fine = fine.select("*", *counts).select(*at, "_fx", "_fy", best.alias("_leaf"), F.when(F.col(f"_c{DEPTH}") > crowd, F.ceil(F.col(f"_c{DEPTH}") / crowd)).otherwise(F.lit(1)).cast("int").alias("_salts"))
    fine = written(fine, "crowded-cells")
    whole = F.struct(F.lit(0).alias("d"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    salt = F.pmod(F.xxhash64(*[c for c in placed.columns if c not in ("_level", "_tx", "_ty", "_fx", "_fy")]), F.coalesce("_salts", F.lit(1))).cast("int")
    points = placed.join(maybe_broadcast(fine), [*at, "_fx", "_fy"], "left").withColumns({"_leaf": F.coalesce("_leaf", whole), "_salt": salt}).drop("_fx", "_fy", "_salts")
    leaves = fine.groupBy(*at, "_leaf").agg(F.max("_salts").alias("_salts"))
    quarters = spread.join(maybe_broadcast(leaves), at, "left").withColumn("_box", G.bounds(F.col("ring")))
    low = lambda t, k: (F.col(t) + F.col(f"_leaf.{k}") / F.pow(F.lit(2.0), F.col("_leaf.d"))) * side
    high = lambda t, k: (F.col(t) + (F.col(f"_leaf.{k}") + 1) / F.pow(F.lit(2.0), F.col("_leaf.d"))) * side
    slack = side * 1e-9
    meets = (F.col("_box.maxx") >= low("_tx", "x") - slack) & (F.col("_box.minx") <= high("_tx", "x") + slack) & (F.col("_box.maxy") >= low("_ty", "y") - slack) & (F.col("_box.miny") <= high("_ty", "y") + slack)
    kept = quarters.where(F.col("_leaf").isNull() | meets)
    shapes = kept.withColumns({"_leaf": F.coalesce("_leaf", whole), "_salt": F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))}).drop("_salts", "_box")
    return points, shapes
