"""Zonal statistics: of a field, of grid cells without any join, and of polygons by the tile join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import points_in_polygons


def statistics(value: Column) -> list[Column]:
    """mean, min, max, std (population) and pixel_count of the values that aren't NULL."""
    return [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.count(value).alias("pixel_count")]


def by_key(pixels: DataFrame, value: Column, *keys: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(*statistics(value))


def by_cell(pixels: DataFrame, value: Column, height: int, width: int) -> DataFrame:
    """Statistics of axis-parallel plots of ``height`` x ``width`` pixels: a projection, no join."""
    cells = pixels.withColumns({"plot_row": F.floor(F.col("px_row") / height).cast("int"), "plot_col": F.floor(F.col("px_col") / width).cast("int"), "value": value})
    out = cells.groupBy("boundary_id", "plot_row", "plot_col").agg(*statistics(F.col("value")), F.count_if(F.col("value").isNull()).alias("no_data_count"))
    reason = F.when(F.col("pixel_count") == 0, F.lit("no valid pixels"))
    return out.withColumn("no_data_reason", reason)


def by_polygon(pixels: DataFrame, polygons: DataFrame, value: Column, tile: float = 16.0) -> DataFrame:
    """Statistics of polygons (boundary_id, plot_id, ring in pixel coordinates) over the pixels whose centres they hold.

    Plots that overlap each get a shared pixel; a plot without pixels stays, with NULLs and a count of 0.
    """
    points = pixels.select("boundary_id", (F.col("px_col") + 0.5).alias("x"), (F.col("px_row") + 0.5).alias("y"), value.alias("value"))
    hits = points_in_polygons(points, polygons.select("boundary_id", "plot_id", "ring"), ["boundary_id"], tile)
    found = hits.groupBy("boundary_id", "plot_id").agg(*statistics(F.col("value")), F.count_if(F.col("value").isNull()).alias("no_data_count"))
    out = polygons.select("boundary_id", "plot_id").join(found, ["boundary_id", "plot_id"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"pixel_count": F.coalesce("pixel_count", zero), "no_data_count": F.coalesce("no_data_count", zero)}).withColumn("no_data_reason", F.when(F.col("pixel_count") == 0, F.lit("no valid pixels")))


def plants_per_plot(plants: DataFrame, plots: DataFrame, tile: float = 16.0) -> DataFrame:
    """Plants strictly inside each plot: plot_id, plant_count, mean_canopy_area_m2 (4 digits, NULL without plants)."""
    hits = points_in_polygons(plants, plots.select("boundary_id", "plot_id", "ring"), ["boundary_id"], tile, strict=True)
    found = hits.groupBy("boundary_id", "plot_id").agg(F.count(F.lit(1)).alias("n"), F.avg("canopy_area_m2").alias("m"))
    out = plots.select("boundary_id", "plot_id").join(found, ["boundary_id", "plot_id"], "left")
    return out.select("boundary_id", "plot_id", F.coalesce("n", F.lit(0).cast("long")).alias("plant_count"), F.round("m", 4).alias("mean_canopy_area_m2"))
