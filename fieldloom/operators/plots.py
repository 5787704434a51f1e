"""Plot layouts: regular grids, row and column assignment, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from . import rings


def grid_estimate(width: Column, height: Column, target: Column) -> dict[str, Column]:
    """Rows and columns of about ``target`` plots for a bounding box, rounding halves to even."""
    aspect = width / F.greatest(height, F.lit(1e-9))
    cols = F.greatest(F.lit(1).cast("long"), F.rint(F.sqrt(target * aspect)).cast("long"))
    return {"cols": cols, "rows": F.greatest(F.lit(1).cast("long"), F.rint(target / cols).cast("long"))}


def grid_plots(boundaries: DataFrame, rows: Column | int, cols: Column | int, row_gap_m: float = 0.0, col_gap_m: float = 0.0) -> DataFrame:
    """Cells of each boundary's bounding box, clipped to it: boundary_id, plot_id, row_idx, col_idx, polygons, ring, area_m2.

    ``boundaries`` has boundary_id and ring, in degrees, and may have ``holes``, an array of rings. A cell's polygons (outer,
    holes) are its true parts, largest first, without bridges between them; ``ring`` is the outer ring of the first. Rows count from
    the south; plots are numbered in row-major order over the cells that remain. Rows and columns below 1 give no cell.
    """
    rows, cols = (F.lit(v) if isinstance(v, int) else v for v in (rows, cols))
    base = boundaries.withColumns({"_b": G.bounds(F.col("ring")), "_c": G.centroid(F.col("ring")), "_rows": rows.cast("long"), "_cols": cols.cast("long")}).where("_rows >= 1 AND _cols >= 1")
    per_lon = G.METRES_PER_DEGREE * F.cos(F.radians(F.col("_c.y")))
    base = base.withColumns({"_gx": F.lit(col_gap_m) / per_lon / 2, "_gy": F.lit(row_gap_m / G.METRES_PER_DEGREE / 2), "_per_lon": per_lon, "_w": (F.col("_b.maxx") - F.col("_b.minx")) / F.col("_cols"), "_h": (F.col("_b.maxy") - F.col("_b.miny")) / F.col("_rows")})
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") * F.col("_cols") - 1))
    cells = base.withColumn("_k", cell).withColumns({"row_idx": F.expr("_k div _cols"), "col_idx": F.expr("_k % _cols")})
    low_x, low_y = F.col("_b.minx") + F.col("col_idx") * F.col("_w") + F.col("_gx"), F.col("_b.miny") + F.col("row_idx") * F.col("_h") + F.col("_gy")
    high_x, high_y = F.col("_b.minx") + (F.col("col_idx") + 1) * F.col("_w") - F.col("_gx"), F.col("_b.miny") + (F.col("row_idx") + 1) * F.col("_h") - F.col("_gy")
    cells = cells.withColumns({"_x0": low_x, "_y0": low_y, "_x1": high_x, "_y1": high_y}).where("_x1 > _x0 AND _y1 > _y0")
    holes = F.col("holes") if "holes" in boundaries.columns else F.array().cast(f"array<{G.RING}>")
    # few boundaries make many cells, and clipping them is the work: it goes to all tasks
    cells = cells.repartition(int(boundaries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "boundary_id", "_k")
    cells = cells.withColumn("polygons", rings.polygons_in_box(F.col("ring"), holes, *[F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")]))
    covered = F.transform("polygons", lambda p: G.polygon_area(F.concat(F.array(p["outer"]), p["holes"])))
    cells = cells.withColumn("_area", F.aggregate(covered, F.lit(0.0), lambda s, a: s + a)).where("_area > 0")
    order = W.partitionBy("boundary_id").orderBy("row_idx", "col_idx")
    area = G.rint(F.col("_area") * G.METRES_PER_DEGREE * F.col("_per_lon"), 1)
    return cells.select("boundary_id", (F.row_number().over(order) - 1).alias("plot_id"), F.col("row_idx").cast("int"), F.col("col_idx").cast("int"), "polygons", F.col("polygons")[0]["outer"].alias("ring"), area.alias("area_m2"))


def grid_positions(candidates: DataFrame, group: list[str], tolerance: float = 0.6) -> DataFrame:
    """Rows from the north and columns from the west for plot candidates (x, y in degrees, area_m2, area_px, cand_id).

    Sorted by y from the north, a row ends where the gap to the element before exceeds ``tolerance`` times the side
    of the median plot. Ties keep the larger candidate first, then the smaller id.
    """
    side = candidates.groupBy(*group).agg(F.median(F.when(F.col("area_m2") > 0, F.col("area_m2"))).alias("_m"))
    limit = F.greatest(F.sqrt(F.coalesce("_m", F.lit(1.0))) / G.METRES_PER_DEGREE * tolerance, F.lit(1e-9))
    rows = candidates.join(side.select(*group, limit.alias("_limit")), group)
    north = W.partitionBy(*group).orderBy(F.desc("y"), F.desc("area_px"), "cand_id")
    gap = F.lag("y").over(north) - F.col("y")
    rows = rows.withColumn("_new", F.when(gap > F.col("_limit"), 1).otherwise(0))
    rows = rows.withColumn("row_idx", F.sum("_new").over(north).cast("int"))
    west = W.partitionBy(*group, "row_idx").orderBy("x", F.desc("y"), F.desc("area_px"), "cand_id")
    rows = rows.withColumn("col_idx", F.row_number().over(west) - 1)
    order = W.partitionBy(*group).orderBy("row_idx", "col_idx")
    return rows.withColumn("plot_id", F.row_number().over(order) - 1).drop("_new", "_limit")
