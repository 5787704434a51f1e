"""Neighbourhood operators on pixel tables (group, px_row, px_col, ...), in tiles that overlap as far as they reach.

Steps that need an ordered sweep run as numpy kernels over rows (distance transform) or connected regions (watershed,
contours), which are independent, so they spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import spectral
from fieldloom.storage import by_size, shuffled, written
from . import kernels, outlines, plots, ranks, rings
from .components import label_regions, label_runs


#: Side of the tiles in which neighbourhoods are computed.
TILE = 256


def stencil(df: DataFrame, group: str, value: str, steps: list[tuple[str, int]]) -> DataFrame:
    """``df`` with ``value`` after the ``steps`` (max or min, reach) over squares of side 2 * reach + 1, one after another.

    Pixels are dealt into tiles once, those near an edge into the neighbouring tiles too, as far as all steps reach; so any number of
    steps costs one shuffle, and a task holds a tile. What lies outside the raster, missing pixels and NULLs are left out.
    """
    halo = sum(reach for _, reach in steps)
    side = max(TILE, 2 * halo)
    tiles = lambda at: F.explode(F.sequence(F.floor((F.col(at) - halo) / side).cast("int"), F.floor((F.col(at) + halo) / side).cast("int")))
    dealt = df.withColumn("_tr", tiles("px_row")).withColumn("_tc", tiles("px_col"))

    def one(t: pa.Table) -> pa.Table:
        r, c = t.column("px_row").to_numpy(), t.column("px_col").to_numpy()
        core = (r // side == t.column("_tr")[0].as_py()) & (c // side == t.column("_tc")[0].as_py())
        kind = t.schema.field(value).type
        after = kernels.stencil(r, c, t.column(value).cast(pa.float64()).to_numpy(), steps)[core]
        t = t.drop_columns(["_tr", "_tc"]).filter(pa.array(core))
        return t.set_column(t.schema.get_field_index(value), value, pa.array(np.nan_to_num(after), pa.float64(), mask=np.isnan(after)).cast(kind))

    return dealt.groupBy(group, "_tr", "_tc").applyInArrow(one, df.schema)


def dilate(df: DataFrame, value: str, size: int = 3, group: str = "boundary_id") -> DataFrame:
    return stencil(df, group, value, [("max", size // 2)])


def erode(df: DataFrame, value: str, size: int = 3, group: str = "boundary_id") -> DataFrame:
    return stencil(df, group, value, [("min", size // 2)])


def _open(size: int, times: int) -> list[tuple[str, int]]:
    """n passes of a square equal one pass of a square n times as far."""
    return [("min", size // 2 * times), ("max", size // 2 * times)]


def morph_open(df: DataFrame, value: str, size: int = 3, times: int = 1, group: str = "boundary_id") -> DataFrame:
    """``times`` erosions, then as many dilations."""
    return stencil(df, group, value, _open(size, times))


def morph_close(df: DataFrame, value: str, size: int = 3, times: int = 1, group: str = "boundary_id") -> DataFrame:
    return stencil(df, group, value, _open(size, times)[::-1])


def morph_close_open(df: DataFrame, value: str, close: int, close_times: int, opened: int, group: str = "boundary_id") -> DataFrame:
    """A closing, then an opening of one pass; a size of 0 leaves its step out."""
    steps = (_open(close, close_times)[::-1] if close else []) + (_open(opened, 1) if opened else [])
    return stencil(df, group, value, steps) if steps else df


def local_maxima(df: DataFrame, value: str, reach: int = 8, group: str = "boundary_id") -> DataFrame:
    """``df`` with ``peak``: positive values that no value within ``reach`` in both axes exceeds; plateaus are peaks whole."""
    top = stencil(df.withColumn("_top", F.col(value)), group, "_top", [("max", reach)])
    return top.withColumn("peak", (F.col(value) > 0) & (F.col(value) == F.col("_top"))).drop("_top")


def _of_rasters(df: DataFrame) -> DataFrame:
    """A table of a row for each raster, to be joined with the pixels that it was made from: computed once, and sent by its measured size."""
    return by_size(written(df, "rasters"))


def excess_green(rgb: DataFrame, group: str = "raster_id") -> DataFrame:
    """``rgb`` with ``exg``; whether channels are scaled depends on the whole raster's largest value."""
    top = rgb.groupBy(group).agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    joined = rgb.join(_of_rasters(top), group)
    return joined.withColumn("exg", spectral.excess_green(F.col("r"), F.col("g"), F.col("b"), F.col("_top"))).drop("_top")


def normalize(df: DataFrame, value: str, out: str, group: str = "raster_id") -> DataFrame:
    """``value`` from its raster's least to its greatest onto 0..255, truncated; a constant raster is 0."""
    span = df.groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    wide = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    scaled = F.coalesce(F.floor((F.col(value) - F.col("_low")) / wide * 255.0), F.when(F.col(value).isNotNull(), F.lit(0).cast("long")))
    return df.join(_of_rasters(span), group).withColumn(out, scaled.cast("int")).drop("_low", "_high")


def otsu(df: DataFrame, value: str, group: str = "raster_id") -> DataFrame:
    """The threshold of 0..255 levels that maximises the variance between the classes (<= t, > t): group, threshold.

    Only the histogram, at most 256 rows per raster, meets in a window.
    """
    bins = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    low = W.partitionBy(group).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(group)
    sums = bins.select(group, "level", F.sum("n").over(low).alias("w0"), F.sum(F.col("n") * F.col("level")).over(low).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("level")).over(every).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0))
    between = F.coalesce(F.col("w0").cast("double") * w1.cast("double") * gap * gap, F.lit(0.0))
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("between"), "level"))
    return sums.withColumn("between", between).withColumn("_k", best).where("_k = 1").select(group, F.col("level").alias("threshold"))


def exg_mask(rgb: DataFrame, group: str = "raster_id") -> DataFrame:
    """Excess green, its 0..255 level and whether the level exceeds the raster's Otsu threshold."""
    levels = normalize(excess_green(rgb, group), "exg", "level", group)
    return levels.join(_of_rasters(otsu(levels, "level", group)), group).withColumn("plant", F.col("level") > F.col("threshold"))


def percentile_stretch(df: DataFrame, value: str, out: str, group: str = "raster_id", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``value`` from its 1st to its 99th percentile (interpolated) onto 0..255, truncated."""
    ends = by_size(ranks.quantiles(df, value, group, [low, high]))
    share = (F.col(value) - F.col("_p")[0]) / F.greatest(F.col("_p")[1] - F.col("_p")[0], F.lit(1e-6))
    return df.join(ends, group).withColumn(out, F.floor(spectral.clip(share, 0.0, 1.0) * 255.0).cast("int")).drop("_p")


def block_average(df: DataFrame, values: list[str], factor: int, group: str = "raster_id") -> DataFrame:
    """Preview: means of ``factor`` x ``factor`` blocks."""
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return df.groupBy(group, cell("px_row"), cell("px_col")).agg(*[F.avg(v).alias(v) for v in values])


def threshold_mask(value: str, above: float) -> Column:
    """Vegetation: NULL counts as -1."""
    return F.coalesce(F.col(value), F.lit(-1.0)) > above


def segment_filter(segments: DataFrame, shapes: DataFrame, least: float = 0.004, most: float = 0.30, border: float = 0.5) -> DataFrame:
    """Segments (raster_id, segment, px_row, px_col) that are neither too small nor too large nor mostly border.

    ``shapes`` has raster_id, height and width. The border share is the mean over the four edge strips; a corner
    pixel is in two of them.
    """
    s = segments.join(by_size(shapes), "raster_id")
    edges = lambda c, end: (F.col(c) == 0).cast("int") + (F.col(c) == F.col(end) - 1).cast("int")
    s = s.withColumn("_e", edges("px_row", "height") + edges("px_col", "width"))
    size = F.first("height").cast("double") * F.first("width")
    ring = 2 * (F.first("height") + F.first("width"))
    found = s.groupBy("raster_id", "segment").agg((F.count(F.lit(1)) / size).alias("area_frac"), (F.sum("_e") / ring).alias("border_frac"))
    return found.where((F.col("area_frac") >= least) & (F.col("area_frac") <= most) & (F.col("border_frac") <= border))


# Grouped kernels


def squared_distance(mask: DataFrame, group: str = "raster_id", value: str = "plant") -> DataFrame:
    """``mask`` with ``d2``, the exact squared distance of each pixel to the nearest that isn't in the mask; NULL if the raster has none.

    Columns first: two window sweeps find the nearest such pixel above and below. Then each row takes the lower envelope of the
    parabolas that its columns raise; rows go to tasks one by one, so no task holds a raster. Pixels that aren't there are no background.
    """
    here = mask.select(group, "px_row", "px_col", F.coalesce(F.col(value), F.lit(False)).alias("_on"))
    column = W.partitionBy(group, "px_col").orderBy("px_row")
    zero = F.when(~F.col("_on"), F.col("px_row"))
    up = F.last(zero, True).over(column.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(zero, True).over(column.rowsBetween(0, W.unboundedFollowing))
    away = here.select(group, "px_row", "px_col", F.least(F.col("px_row") - up, down - F.col("px_row")).cast("long").alias("_g"))
    lines = away.groupBy(group, "px_row").agg(F.array_sort(F.collect_list(F.struct("px_col", "_g"))).alias("_line"))
    kind = mask.schema[group].dataType.simpleString()

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line = b.column("_line")
            at = line.flatten()
            d2 = kernels.row_envelopes(np.diff(line.offsets.to_numpy()), at.field("px_col").to_numpy(), at.field("_g").to_numpy(zero_copy_only=False))
            found = pa.StructArray.from_arrays([at.field("px_col"), pa.array(np.nan_to_num(d2, nan=0).astype(np.int64), mask=np.isnan(d2))], ["px_col", "d2"])
            offsets = pa.array(np.append(0, np.cumsum(np.diff(line.offsets.to_numpy()))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("px_row"), pa.ListArray.from_arrays(offsets, found)], [group, "px_row", "_line"])

    done = lines.mapInArrow(envelope, f"{group} {kind}, px_row int, _line array<struct<px_col:int,d2:bigint>>")
    return done.select(group, "px_row", F.inline("_line"))


def distance_transform(mask: DataFrame, group: str = "raster_id", value: str = "plant") -> DataFrame:
    """Exact Euclidean distance of each mask pixel to the nearest pixel that is not: group, px_row, px_col, distance."""
    return squared_distance(mask, group, value).select(group, "px_row", "px_col", F.sqrt(F.col("d2").cast("double")).alias("distance"))


#: Pixels of connected regions that one task floods at once, about.
FLOOD = 1 << 18
#: Squared distance in a raster without background.
_NO_BACKGROUND = 1 << 40


def watershed(mask: DataFrame, group: str = "raster_id", value: str = "plant", reach: int = 8) -> DataFrame:
    """Mask pixels with ``plant_id``: flooding from the distance peaks; peaks that touch are one marker.

    The raster's edge is no background. Distances, peaks and connected regions are found by all tasks; floods don't cross from one
    4-connected region to another, so regions, not rasters, are dealt to tasks: a region must fit one. Plants are numbered from 1 in the order
    of their markers' first pixels, row by row. Regions without a peak have no plant.
    """
    kind = mask.schema[group].dataType.simpleString()
    far = squared_distance(mask, group, value).withColumn("d2", F.coalesce("d2", F.lit(_NO_BACKGROUND)))
    peaks = written(local_maxima(far, "d2", reach, group).where("d2 > 0"), "flood-pixels")
    regions = written(label_regions(peaks, group), "flood-regions")
    sizes = regions.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / FLOOD).alias("_tasks"))
    dealt = regions.join(by_size(sizes), group).withColumn("_deal", F.pmod(F.xxhash64("region"), "_tasks"))

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernels.flood_regions(pdf, group)

    flat = dealt.select(group, "_deal", "px_row", "px_col", "d2", "peak", F.col("region.row").alias("row0"), F.col("region.col").alias("col0"))
    flooded = written(flat.groupBy(group, "_deal").applyInPandas(flood, f"{group} {kind}, px_row int, px_col int, marker_row int, marker_col int"), "flood-labels")
    order = W.partitionBy(group).orderBy("marker_row", "marker_col")
    plants = flooded.select(group, "marker_row", "marker_col").distinct().withColumn("plant_id", F.row_number().over(order))
    return flooded.join(by_size(plants), [group, "marker_row", "marker_col"]).select(group, "px_row", "px_col", "plant_id")


def plant_blobs(labels: DataFrame, group: str = "raster_id", least: int = 15) -> DataFrame:
    """Area and centroid of each labelled plant of at least ``least`` pixels."""
    return labels.groupBy(group, "plant_id").agg(F.count(F.lit(1)).alias("area_px"), F.avg("px_row").alias("row"), F.avg("px_col").alias("col")).where(F.col("area_px") >= least)


def count_plants(rgb: DataFrame, group: str = "raster_id", least: int = 15, reach: int = 8) -> DataFrame:
    """Plants of each raster: mask, opening, distance peaks, watershed, area filter."""
    mask = exg_mask(rgb, group).select(group, "px_row", "px_col", F.col("plant").cast("int").alias("plant"))
    mask = morph_open(mask, "plant", 3, 1, group).withColumn("plant", F.col("plant") == 1)
    return plant_blobs(watershed(mask, group, "plant", reach), group, least)


def plant_summary(rgb: DataFrame, group: str = "raster_id", least: int = 15, reach: int = 8) -> DataFrame:
    blobs = count_plants(rgb, group, least, reach).groupBy(group).agg(F.count(F.lit(1)).alias("plant_count"), F.avg("area_px").alias("mean_area_px"))
    rasters = rgb.select(group).distinct()
    return rasters.join(shuffled(blobs), group, "left").select(group, F.coalesce("plant_count", F.lit(0).cast("long")).alias("plant_count"), F.coalesce("mean_area_px", F.lit(0.0)).alias("mean_area_px"))


def canopy_area(area_px: Column, a: Column, e: Column) -> Column:
    return F.round(area_px * F.abs(a * e), 4)


def field_boundaries(mask: DataFrame, group: str = "boundary_id", value: str = "plant", least: float = 500.0, close: int = 5, close_times: int = 2, opened: int = 5) -> DataFrame:
    """Outer contours of the closed and opened mask: ring (pixel centres), area_px, confidence (rectangularity), place.

    A contour's area is that of the polygon through its pixel centres. Regions are 8-connected, holes are ignored;
    contours below ``least`` or of fewer than 3 vertices after simplification (1 % of the perimeter) go. A ring that
    touches or crosses itself is repaired: its largest valid part stays, and none if it has no area. ``place`` numbers a
    group's candidates from 0 by falling area, then from the north, then from the west.
    """
    m = mask.select(group, "px_row", "px_col", F.col(value).cast("int").alias("_v"))
    m = morph_close_open(m, "_v", close, close_times, opened, group)
    labelled = written(label_runs(m.where("_v = 1").drop("_v"), group, diagonal=True).select(group, "px_row", "c0", "c1", F.col("region.row").alias("row0"), F.col("region.col").alias("col0")), "contour-runs")
    # a contour's area is at most that of the box through its outermost pixel centres
    box = labelled.groupBy(group, "row0", "col0").agg(((F.max("px_row") - F.min("px_row")) * (F.max("c1") - F.min("c0"))).alias("_box"))
    large = by_size(box.where(F.col("_box") >= least).select(group, "row0", "col0"))
    flat = labelled.join(large, [group, "row0", "col0"], "left_semi")
    kind = flat.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernels.contour_row(pdf, group)

    schema = f"{group} {kind}, row0 int, col0 int, ring array<struct<x:double,y:double>>, area_px double, confidence double"
    found = flat.groupBy(group, "row0", "col0").applyInPandas(one, schema).where((F.col("area_px") >= least) & (F.size("ring") >= 3))
    whole = found.withColumn("_ok", rings.valid(F.col("ring")))
    whole = whole.withColumn("ring", F.when(F.col("_ok"), F.col("ring")).otherwise(F.try_element_at(rings.repair(F.col("ring")), F.lit(1)))).where("ring IS NOT NULL").drop("_ok")
    order = F.row_number().over(W.partitionBy(group).orderBy(F.desc("area_px"), "row0", "col0"))
    return whole.withColumn("place", order - 1)


def georeferenced(candidates: DataFrame, rasters: DataFrame, group: str, anchor: str = "centre", scale: str | None = None) -> DataFrame:
    """Candidates with ``ring`` in degrees, ``area_m2`` in the raster's own units and the centroid x, y in degrees.

    ``rasters`` has the group, crs and affine. ``scale`` names a column that pixel coordinates are multiplied by first. The
    area is that of the ring in the raster's system, rounded to 2 digits; in a system of degrees it is the local metric one.
    """
    codes = [r["crs"] for r in rasters.select("crs").distinct().collect()]  # as many as there are reference systems
    rows = candidates.join(by_size(rasters.select(group, "crs", "affine")), group)
    by = F.col(scale) if scale else F.lit(1.0)
    own = F.transform("ring", lambda p: G.pixel_to_map(p["y"] * by, p["x"] * by, F.col("affine"), anchor))
    rows = rows.withColumn("_own", own)
    rows = rows.withColumn("ring", G.ring_to_wgs84(F.col("_own"), F.col("crs"), codes)).withColumn("_c", G.centroid(F.col("ring")))
    flat = G.ring_area(F.col("_own"))
    area = F.when(F.col("crs") == "EPSG:4326", G.metric_area(flat, F.col("_c.y"))).otherwise(flat)
    return rows.withColumns({"area_m2": G.rint(area, 2), "x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_own", "_c", "crs", "affine")


def plots_from_mask(mask: DataFrame, rasters: DataFrame, group: str = "raster_id", value: str = "plant", least: float = 300.0, tolerance: float = 0.6) -> DataFrame:
    """Plots of a vegetation mask: contours, in degrees, with areas from the raster's own system, numbered by rows and columns.

    boundary columns: group, plot_id, row_idx, col_idx, ring, area_px, area_m2, confidence.
    """
    found = georeferenced(field_boundaries(mask, group, value, least), rasters, group).withColumn("cand_id", F.col("place"))
    numbered = plots.grid_positions(found, [group], tolerance)
    return numbered.select(group, "plot_id", "row_idx", "col_idx", "ring", F.floor("area_px").cast("long").alias("area_px"), "area_m2", "confidence")


#: Fixed values of segment extraction: longest side of the picture that is segmented.
SEGMENT_SIDE = 768


def plots_from_segments(segments: DataFrame, shapes: DataFrame, rasters: DataFrame, tolerance: float = 0.6, least: float = 0.004, most: float = 0.30, border: float = 0.5) -> DataFrame:
    """Plots from a segmenter's masks over pictures scaled down to SEGMENT_SIDE.

    ``segments`` has raster_id, segment, px_row, px_col and stability, in pixels of the scaled picture; ``shapes`` has
    raster_id, height and width of that picture and its ``scale`` (original pixels a scaled one); ``rasters`` the
    original's crs and affine. Segments too small, too large or mostly border go. Of a segment's contours the largest
    counts; it is repaired, simplified keeping its topology, and goes below an area of 4 or if it isn't valid in map
    coordinates. Corners, not centres, are carried back through the original's affine.
    """
    kept = written(segment_filter(segments, shapes, least, most, border).select("raster_id", "segment"), "kept-segments")
    flat = segments.join(by_size(kept), ["raster_id", "segment"]).withColumn("seg", F.struct("raster_id", "segment"))
    regions = label_runs(flat.select("seg", "px_row", "px_col"), "seg", diagonal=True)
    schema = "raster_id long, segment long, ring array<struct<x:double,y:double>>, area_px double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = kernels.contour_row(pdf, "raster_id", simple=False)
        return pd.DataFrame({"raster_id": row["raster_id"], "segment": [pdf["segment"].iloc[0]], "ring": row["ring"], "area_px": row["area_px"]})

    pieces = regions.select(F.col("seg.raster_id").cast("long").alias("raster_id"), F.col("seg.segment").cast("long").alias("segment"), "px_row", "c0", "c1", F.col("region.row").alias("row0"), F.col("region.col").alias("col0"))
    contours = pieces.groupBy("raster_id", "segment", "row0", "col0").applyInPandas(one, schema)
    largest = contours.groupBy("raster_id", "segment").agg(F.max_by("ring", "area_px").alias("ring")).where(F.size("ring") >= 3)
    largest = largest.withColumn("ring", F.try_element_at(rings.repair(F.col("ring")), F.lit(1))).where("ring IS NOT NULL")
    largest = largest.withColumn("ring", rings.simplify(F.col("ring"))).where(G.ring_area(F.col("ring")) >= 4)
    counts = segments.groupBy("raster_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("stability"), 3).alias("confidence"))
    found = largest.join(shuffled(counts), ["raster_id", "segment"]).join(by_size(shapes.select("raster_id", "scale")), "raster_id")
    found = found.withColumn("area_px", F.floor(F.col("n") * F.col("scale") * F.col("scale")).cast("long"))
    found = georeferenced(found, rasters, "raster_id", "corner", "scale").where(rings.valid(F.col("ring")))
    order = F.row_number().over(W.partitionBy("raster_id").orderBy(F.desc("area_px"), "segment"))
    numbered = plots.grid_positions(found.withColumn("cand_id", order - 1), ["raster_id"], tolerance)
    return numbered.select("raster_id", "plot_id", "row_idx", "col_idx", "segment", "ring", "area_px", "area_m2", "confidence")


def extraction_methods(segmenter=None) -> list[tuple[str, bool, str | None]]:
    """(method, available, reason): the vegetation mask always is; a segmenter is if it is callable and its ``probe``, if any, finds nothing against it."""
    if segmenter is None:
        return [("vegetation", True, None), ("segmenter", False, "no segmenter is registered")]
    if not callable(segmenter):
        return [("vegetation", True, None), ("segmenter", False, "the segmenter can't be called")]
    try:
        reason = getattr(segmenter, "probe", lambda: None)()
    except Exception as e:  # noqa: BLE001  a probe that fails says why
        reason = f"{type(e).__name__}: {e}"
    return [("vegetation", True, None), ("segmenter", reason is None, reason)]


def zone_polygons(zoned: DataFrame, group: str = "boundary_id") -> DataFrame:
    """Each zone as a MultiPolygon in pixel coordinates: group, zone, polygons (outer ring and its holes), rings, pixel_count, region_count.

    Outer rings run one way and holes the other, so the signed areas of ``rings`` add up to the pixel count.
    """
    return outlines.multipolygons(outlines.regions(zoned, group, "zone"), group, "zone")
