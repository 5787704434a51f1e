"""Outlines of labelled pixels: rings are chained by pointer jumping, holes are put into their outer rings.

No task holds a raster or a region: pixels are compared with their neighbours, sides that two pixels of a label share cancel, sides
in line become one, and the sides' order round a ring comes from doubled steps, as many rounds as the longest ring has
binary digits. Only a finished ring is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.storage import written
from .components import components, runs

#: Directions of a pixel's sides with the pixel on the left: top to the west, left to the south, bottom to the east, right to the north.
WEST, SOUTH, EAST, NORTH = range(4)
#: Doublings that one job makes.
AT_ONCE = 3


def sides(pixels: DataFrame, group: str, label: str) -> DataFrame:
    """Straight outline sides of equal labels: side (its id: group, label, direction and start), x0, y0, x1, y1 in pixel corners."""
    row, column = W.partitionBy(group, "px_row").orderBy("px_col"), W.partitionBy(group, "px_col").orderBy("px_row")
    joins = lambda at, near, over: F.coalesce((F.lag if near < 0 else F.lead)(F.struct(at, label)).over(over) == F.struct(F.col(at) + near, F.col(label)), F.lit(False))
    p = pixels.select(group, label, "px_row", "px_col")
    p = p.withColumns({"_w": joins("px_col", -1, row), "_e": joins("px_col", 1, row), "_n": joins("px_row", -1, column), "_s": joins("px_row", 1, column)})
    r, c = F.col("px_row"), F.col("px_col")
    # (direction, the line that the side lies on, its place along the line)
    unit = lambda there, way, line, at: F.when(~F.col(there), F.struct(F.lit(way).alias("way"), line.alias("line"), at.alias("at")))
    found = F.array(unit("_n", WEST, r, c), unit("_w", SOUTH, c, r), unit("_s", EAST, r + 1, c), unit("_e", NORTH, c + 1, r))
    units = p.select(group, label, F.explode(F.filter(found, lambda s: s.isNotNull())).alias("u")).select(group, label, "u.*")
    along = W.partitionBy(group, label, "way", "line").orderBy("at")
    stretch = F.col("at") - F.row_number().over(along)  # the same for places in line without a gap
    straight = units.withColumn("_k", stretch).groupBy(group, label, "way", "line", "_k").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    back = F.col("way").isin(WEST, NORTH)
    first, last = F.when(back, F.col("high")).otherwise(F.col("low")), F.when(back, F.col("low")).otherwise(F.col("high"))
    flat = F.col("way").isin(WEST, EAST)
    point = lambda at: (F.when(flat, at).otherwise(F.col("line")), F.when(flat, F.col("line")).otherwise(at))
    (x0, y0), (x1, y1) = point(first), point(last)
    ends = straight.select(group, label, "way", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return ends.withColumn("side", F.struct(group, label, "y0", "x0", "way"))


def chained(straight: DataFrame, group: str, label: str) -> DataFrame:
    """``straight`` with ``ring``, the least side of its ring, and ``place``, the steps from that side.

    Where four sides meet, a ring turns round its own pixel, so pixels that touch at a corner stay apart.
    """
    starts = straight.select(group, label, F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("way").alias("to"), F.col("side").alias("next"))
    own = starts.withColumn("way", F.pmod(F.col("to") + 3, F.lit(4)))
    other = starts.withColumn("way", F.pmod(F.col("to") + 1, F.lit(4)))
    key = [group, label, "x1", "y1", "way"]
    links = straight.select("side", *key).join(own.select(*key, F.col("next").alias("_own")), key, "left").join(other.select(*key, F.col("next").alias("_other")), key, "left")
    # over the next ``span`` sides: the least, the steps to it, and the side after them
    walk = written(links.select("side", F.coalesce("_own", "_other").alias("next"), F.col("side").alias("ring"), F.lit(0).cast("long").alias("ahead")), "outline-walk")
    span = 1
    while True:
        after = walk.withColumn("_was", F.col("ring"))
        for _ in range(AT_ONCE):
            far = after.select(F.col("side").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
            less = F.col("_ring") < F.col("ring")
            after = after.join(far, "next").select("side", F.col("_next").alias("next"), "_was", F.when(less, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"), F.when(less, F.col("_ring")).otherwise(F.col("ring")).alias("ring"))
            span *= 2
        after = written(after, "outline-walk")
        walk = after.drop("_was")
        if after.where("ring != _was").isEmpty():  # the least side of a longer ring would still have come nearer to some
            break
    sizes = W.partitionBy("ring")
    placed = walk.withColumn("place", F.pmod(F.max("ahead").over(sizes) + 1 - F.col("ahead"), F.max("ahead").over(sizes) + 1))
    return straight.join(placed.select("side", "ring", "place"), "side")


def regions(pixels: DataFrame, group: str = "boundary_id", label: str = "zone") -> DataFrame:
    """One row for each 4-connected region of equal labels: group, label, outer ring, holes, area_px.

    Rings are in pixel corners, corners in line left out; holes run the other way than outer rings.
    """
    known = pixels.where(F.col(label).isNotNull()).select(group, label, "px_row", "px_col")
    sided = written(chained(sides(known, group, label), group, label), "outline-sides")
    cross = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).cast("double")
    point = F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    rings = sided.groupBy(group, label, "ring").agg((-F.sum(cross) / 2).alias("area"), F.array_sort(F.collect_list(F.struct("place", point.alias("at")))).alias("_c"))
    rings = written(rings.select(group, label, "ring", "area", F.transform("_c", lambda s: s["at"]).alias("points")), "outline-rings")
    # a hole's westmost side ends a run of pixels; the side at which that run begins is of a ring of the same region, farther west
    holes = sided.where(F.col("way") == NORTH).join(rings.where("area < 0").select("ring"), "ring").groupBy(group, label, "ring").agg(F.min(F.struct("x0", F.col("y1").alias("row"))).alias("at"))
    ends = holes.select(group, F.col(label).alias("value"), F.col("at.row").alias("px_row"), (F.col("at.x0") - 1).alias("c1"), "ring")
    begins = ends.join(runs(known, group, label).select(group, "value", "px_row", "c0", "c1"), [group, "value", "px_row", "c1"]).select(group, F.col("value").alias(label), F.col("c0").alias("x0"), F.col("px_row").alias("row"), "ring")
    lefts = sided.where(F.col("way") == SOUTH).select(group, label, "x0", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("row"), F.col("ring").alias("west"))
    pairs = written(begins.join(lefts, [group, label, "x0", "row"]).select(F.col("ring").alias("a"), F.col("west").alias("b")), "outline-pairs")
    parts = components(pairs) if not pairs.isEmpty() else pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))
    named = rings.join(parts.select(F.col("node").alias("ring"), "component"), "ring", "left").withColumn("region", F.coalesce("component", "ring"))
    outer = F.max(F.when(F.col("area") > 0, F.col("points")))
    inner = F.array_sort(F.collect_list(F.when(F.col("area") < 0, F.col("points"))))
    return named.groupBy(group, label, "region").agg(outer.alias("outer"), inner.alias("holes"), F.sum("area").alias("area_px")).drop("region")


def multipolygons(found: DataFrame, group: str = "boundary_id", label: str = "zone") -> DataFrame:
    """Regions of a label as one MultiPolygon: polygons (outer, holes), rings (all of them), pixel_count and region_count."""
    polygon = F.struct("outer", "holes")
    one = found.groupBy(group, label).agg(F.array_sort(F.collect_list(polygon)).alias("polygons"), F.sum("area_px").cast("long").alias("pixel_count"), F.count(F.lit(1)).alias("region_count"))
    rings = F.flatten(F.transform("polygons", lambda p: F.concat(F.array(p["outer"]), p["holes"])))
    return one.select(group, label, "polygons", rings.alias("rings"), "pixel_count", "region_count")


def covered(polygon: Column) -> Column:
    """Area of a polygon (outer, holes)."""
    return G.ring_area(polygon["outer"]) - F.aggregate(F.transform(polygon["holes"], G.ring_area), F.lit(0.0), lambda s, a: s + a)
