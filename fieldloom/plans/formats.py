"""Queries over the file formats: each writes files as bytes and reads them back with the library's own readers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import spectral
from fieldloom.operators import catalog, plots, zonal
from fieldloom.plans import inputs as I
from fieldloom.plans.inputs import BOXES_SQL, PIXELS_SQL, PLOTS_SQL, RGB_SQL
from fieldloom.sources import raster_source, rasters, reports, shapefile, store, tiff
from fieldloom.storage import scratch

_NDVI = "CASE WHEN abs(nir + red) < 1e-8 THEN (nir - red) / 1e-8 ELSE (nir - red) / (nir + red) END"


def _geotiffs(spark: SparkSession, sf: str) -> DataFrame:
    pix = I.pixels(spark, sf).select("boundary_id", "px_row", "px_col", spectral.index_column("ndvi").alias("ndvi"))
    return tiff.export_geotiff(pix, "ndvi", x=7.0, y=9.5, step=0.01)


def export_geotiff(spark: SparkSession, sf: str) -> DataFrame:
    back = tiff.pixels_of(_geotiffs(spark, sf), "boundary_id", {"ndvi": 1})
    return back.groupBy("boundary_id").agg(F.count("ndvi").alias("n"), F.round(F.sum("ndvi"), 3).alias("total"), F.round(F.min("ndvi"), 6).alias("low"), F.round(F.max("ndvi"), 6).alias("high"))


def _put(files: DataFrame, key: str, data: str = "data", suffix: str = ".tif") -> DataFrame:
    """(key, path): rows of files, written as files of a folder and listed; names are those of the key."""
    kind = files.schema[key].dataType
    named = files.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.col(data).alias("data"))
    found = store.put(named, scratch(files.sparkSession, "files"))
    return found.select(F.regexp_extract("name", r"^(.*)\.", 1).cast(kind).alias(key), "path")


def _content(files: DataFrame, key: str) -> DataFrame:
    """(key, data): the bytes of files by path."""
    read = lambda batches: (b.assign(data=[store.Ranged(p).whole() for p in b["path"]])[[key, "data"]] for b in batches)
    return files.select(key, "path").mapInPandas(read, f"{key} {files.schema[key].dataType.simpleString()}, data binary")


def raster_inspect(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of files, read by byte ranges."""
    return tiff.inspect(_put(_geotiffs(spark, sf), "boundary_id"), "boundary_id").withColumns({c: F.round(c, 6) for c in ("minx", "miny", "maxx", "maxy")})


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    b = I.boxes(spark, sf).select("boundary_id", G.box(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("ring"))
    return plots.grid_plots(b, 2, 3)


def plot_import(spark: SparkSession, sf: str) -> DataFrame:
    """Grid plots written as zipped shapefiles and imported again."""
    grid = _grid(spark, sf).withColumns({"rings": F.array("ring"), "ROW": F.col("row_idx"), "Col_Idx": F.col("col_idx")})
    files = shapefile.export_shapefile(grid, "boundary_id", "rings", ["plot_id", "ROW", "Col_Idx"], "plots", "plot_id")
    back = shapefile.imported_plots(shapefile.read_shapefiles(files, "boundary_id"), "boundary_id")
    return back.select("boundary_id", "plot_id", "row_idx", "col_idx", F.round("area_m2", 0).alias("area_m2"))


def export_xlsx(spark: SparkSession, sf: str) -> DataFrame:
    stats = zonal.by_cell(I.pixels(spark, sf), spectral.index_column("ndvi"), 25, 25).withColumn("plot_id", F.col("plot_row") * 2 + F.col("plot_col"))
    return reports.export_xlsx(stats.select("boundary_id", "plot_id", "mean", "min", "max", "std", "pixel_count"), "boundary_id", "plot_id")


def export_png(spark: SparkSession, sf: str) -> DataFrame:
    spec = spectral.index_of("ndvi")
    colours = spectral.colorize(spectral.index_column("ndvi"), spec.ramp, spec.low, spec.high)
    return reports.export_png(I.pixels(spark, sf).select("boundary_id", "px_row", "px_col", *[c.alias(n) for n, c in colours.items()]), "boundary_id")


def export_report(spark: SparkSession, sf: str) -> DataFrame:
    stats = zonal.by_key(I.pixels(spark, sf), spectral.index_column("ndvi"), "boundary_id")
    names = I.boxes(spark, sf).select(F.col("boundary_id").alias("id"), "name")
    return reports.export_pdf(catalog.report_rows(names, I.plots(spark, sf), stats))


def _read(files: DataFrame, key: str, data: str, schema: str, rows) -> DataFrame:
    """``rows`` (bytes to tuples) of each file, after the key."""
    kind, names = files.schema[key].dataType.simpleString(), [x.split()[0] for x in schema.split(", ")]

    def scan(batches):
        for b in batches:
            found = [(k, *r) for k, d in zip(b[key], b[data]) for r in rows(bytes(d))]
            yield pd.DataFrame(found, columns=[key, *names])

    return files.select(key, data).mapInPandas(scan, f"{key} {kind}, {schema}")


def _cells(data: bytes) -> list[tuple]:
    head, *rows = reports.xlsx_rows(data)
    at = {n: head.index(n) for n in ("plot_id", "mean", "min", "max", "std", "pixel_count")}
    number = lambda v, kind: None if v is None else kind(v)
    return [(int(r[at["plot_id"]]), *(number(r[at[n]], float) for n in ("mean", "min", "max", "std")), int(r[at["pixel_count"]])) for r in rows]


def xlsx_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The sheets' cells, read back."""
    files = _put(export_xlsx(spark, sf), "boundary_id", suffix=".xlsx")
    got = _read(_content(files, "boundary_id"), "boundary_id", "data", "plot_id long, mean double, min double, max double, std double, pixel_count long", _cells)
    return got.withColumns({n: F.round(n, 6) for n in ("mean", "min", "max", "std")})


def png_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Size and channel sums of the overlays, read back from their base64 text."""
    made = export_png(spark, sf).select("boundary_id", F.unbase64("overlay").alias("data"))

    def sums(data: bytes) -> list[tuple]:
        a = reports.png_pixels(data).astype(int)
        return [(a.shape[0], a.shape[1], *(int(v) for v in a.sum((0, 1))))]

    return _read(made, "boundary_id", "data", "height int, width int, r long, g long, b long, a long", sums)


def report_text(spark: SparkSession, sf: str) -> DataFrame:
    """What the reports show, read back: the title and the field's numbers."""
    def shown(data: bytes) -> list[tuple]:
        title, *lines = reports.pdf_lines(data)
        told = dict(x.split(": ", 1) for x in lines)
        return [(title, told["plot_count"], told["mean"], told["pixel_count"])]

    files = _put(export_report(spark, sf), "boundary_id", suffix=".pdf")
    return _read(_content(files, "boundary_id"), "boundary_id", "data", "title string, plot_count string, mean string, pixel_count string", shown)


# Rasters in files: one for each boundary, 10 m a pixel in a UTM zone; a diamond round pixel (25, 25), carried into degrees, clips them.
_STEP, _LEFT, _TOP, _CRS, _REACH = 10.0, 500_000.0, 1_000_000.0, "EPSG:32632", 18.25


def _diamond(keys: DataFrame, key: str) -> DataFrame:
    corner = lambda dx, dy: G.to_wgs84(F.lit(_LEFT + _STEP * (25 + dx)), F.lit(_TOP - _STEP * (25 + dy)), _CRS)
    return keys.select(key).distinct().withColumn("ring", F.array(corner(0, -_REACH), corner(_REACH, 0), corner(0, _REACH), corner(-_REACH, 0)))


def _written_rasters(pixels: DataFrame, key: str, values: list[str], kind: str) -> DataFrame:
    """(key, data): a GeoTIFF of ``values`` as samples of a numpy type; missing pixels are 0."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["px_row"].to_numpy(), pdf["px_col"].to_numpy()
        a = np.zeros((len(values), r.max() + 1, c.max() + 1), kind)
        for k, n in enumerate(values):
            a[k, r, c] = pdf[n].fillna(0).to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "data": [tiff.write_bands(a, _LEFT, _TOP, _STEP, _STEP, int(_CRS[5:]))]})

    return pixels.select(key, "px_row", "px_col", *values).groupBy(key).applyInPandas(one, f"{key} {pixels.schema[key].dataType.simpleString()}, data binary")


def scene_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Red and near-infrared from one 16-bit file each, clipped, in reflectance."""
    pix = I.pixels(spark, sf).select(F.col("boundary_id").alias("scene_id"), "px_row", "px_col", *[F.round(F.col(n) * 10_000).cast("int").alias(n) for n in ("red", "nir")])
    files = [_written_rasters(pix, "scene_id", [n], "uint16").withColumn("role", F.lit(n)) for n in ("red", "nir")]
    assets = files[0].unionByName(files[1]).withColumn("file", F.concat_ws("-", F.col("scene_id").cast("string"), "role"))
    part = lambda k: F.element_at(F.split("file", "-"), k)
    assets = _put(assets, "file").select(part(1).cast("long").alias("scene_id"), part(2).alias("role"), "path")
    got, _ = rasters.scene_bands(assets, _diamond(pix, "scene_id"), ["red", "nir"])
    return got.withColumns({n: F.round(n, 9) for n in ("red", "nir")})


def drone_bands_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of an 8-bit file by a map of roles, clipped, in 0..1."""
    rgb = I.rgb(spark, sf)
    got, _ = rasters.drone_bands(_put(_written_rasters(rgb, "raster_id", ["r", "g", "b"], "uint8"), "raster_id"), _diamond(rgb, "raster_id"), "raster_id", {"red": 1, "blue": 3})
    return got.withColumns({n: F.round(n, 9) for n in ("red", "blue")})


def drone_rgb_clip(spark: SparkSession, sf: str) -> DataFrame:
    """The first three bands of an 8-bit file, black outside the boundary."""
    rgb = I.rgb(spark, sf)
    return rasters.drone_rgb(_put(_written_rasters(rgb, "raster_id", ["r", "g", "b"], "uint8"), "raster_id"), "raster_id", _diamond(rgb, "raster_id"))[0]


def raster_window(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three bands and a window of each file of a folder, both pushed into the raster source."""
    folder = scratch(spark, "rasters")
    files = _written_rasters(I.rgb(spark, sf), "raster_id", ["r", "g", "b"], "uint8")
    store.put(files.select(F.concat(F.col("raster_id").cast("string"), F.lit(".tif")).alias("name"), "data"), folder)
    got = raster_source.registered(spark).read.format("fieldloom_raster").option("path", folder).option("bands", "g:2,b:3").load()
    got = got.where("px_row >= 10 AND px_row < 30 AND px_col <= 20")
    return got.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("raster_id"), "px_row", "px_col", "g", "b")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of rasters: some by another suffix, some cut short, some twice; those that can be read land once."""
    files = _written_rasters(I.rgb(spark, sf), "raster_id", ["r", "g", "b"], "uint8")
    k = F.col("raster_id")
    name = F.concat(k.cast("string"), F.when(k % 4 == 1, ".png").when(k % 3 == 0, ".TIFF").otherwise(".tif"))
    data = F.when(k % 5 == 2, F.expr("substring(data, 1, 6)")).otherwise(F.col("data"))
    sent = files.select(name.alias("name"), data.alias("data"))
    landed = rasters.landed(sent.unionByName(sent.where(F.col("name").startswith("2"))))
    return landed.select("name", "band_count", "width", "height", "crs", "dtype", F.length("file_id").alias("id_length"))


def raster_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Area averages of 50 x 50 pixels on a grid of 20 x 20."""
    rgb = I.rgb(spark, sf)
    shapes = rgb.select("raster_id").distinct().withColumns({"height": F.lit(50), "width": F.lit(50), "out_height": F.lit(20), "out_width": F.lit(20)})
    return rasters.resampled(rgb, ["r", "g", "b"], shapes, "raster_id").withColumns({c: F.round(c, 6) for c in "rgb"})


def preview_png(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the previews of files of 50 x 50 pixels, at most 20 a side, read back, and their bounds in degrees."""
    made = rasters.previews(_written_rasters(I.rgb(spark, sf), "raster_id", ["r", "g", "b"], "uint8"), "raster_id", 20)
    size = _read(made, "raster_id", "png", "height int, width int, opaque long", lambda d: [(*reports.png_pixels(d).shape[:2], int((reports.png_pixels(d)[:, :, 3] == 255).sum()))])
    return size.join(made.select("raster_id", F.round("west", 6).alias("west"), (F.col("south") < F.col("north")).alias("upright")), "raster_id")


_OWN = (export_geotiff, raster_inspect, plot_import, export_xlsx, export_png, export_report, xlsx_cells, png_sums, report_text, scene_bands, drone_bands_clip, drone_rgb_clip, raster_window, uploads, raster_resample, preview_png)
QUERIES = {f.__name__: f for f in _OWN}

_STATS = "round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std, count(v) AS pixel_count"
_CLIP = "abs(px_col + 0.5e0 - 25) + abs(px_row + 0.5e0 - 25) < 18.25"
_WINDOW = "px_row BETWEEN 6 AND 43 AND px_col BETWEEN 6 AND 43"
_RAMP = spectral.RAMPS["RdYlGn"]


def _shade(k: int) -> str:
    a, b, c = (s[k] for s in _RAMP)
    return f"sum(coalesce(floor(CASE WHEN t < 0.5 THEN {a} + ({b - a}) * (t / 0.5e0) ELSE {b} + ({c - b}) * ((t - 0.5e0) / 0.5e0) END), 0))::bigint"


ORACLES = {
    "xlsx_cells": f"WITH {PIXELS_SQL}, c AS (SELECT boundary_id, (px_row // 25) * 2 + px_col // 25 AS plot_id, {_NDVI} AS v FROM pixels) SELECT boundary_id, plot_id::bigint AS plot_id, {_STATS} FROM c GROUP BY 1, 2",
    "png_sums": f"WITH {PIXELS_SQL}, c AS (SELECT *, least(greatest(({_NDVI} - -0.2e0) / (0.9e0 - -0.2e0), 0), 1) AS u, {_NDVI} AS value FROM pixels), t AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE u END AS t FROM c) SELECT boundary_id, (max(px_row) + 1)::int AS height, (max(px_col) + 1)::int AS width, {_shade(0)} AS r, {_shade(1)} AS g, {_shade(2)} AS b, (255 * count(value))::bigint AS a FROM t GROUP BY 1",
    "report_text": f"WITH {PIXELS_SQL}, {BOXES_SQL}, {PLOTS_SQL}, c AS (SELECT boundary_id, count(*) AS n FROM plots GROUP BY 1), s AS (SELECT boundary_id, avg({_NDVI}) AS mean, count({_NDVI}) AS n FROM pixels GROUP BY 1) SELECT boundary_id, coalesce(name, 'Unnamed Farm') AS title, coalesce(c.n, 0)::varchar AS plot_count, coalesce(printf('%.3f', mean), 'n/a') AS mean, coalesce(s.n::varchar, 'n/a') AS pixel_count FROM boxes LEFT JOIN c USING (boundary_id) LEFT JOIN s USING (boundary_id)",
    "scene_bands": f"WITH {PIXELS_SQL} SELECT boundary_id AS scene_id, px_row - 6 AS px_row, px_col - 6 AS px_col, CASE WHEN {_CLIP} THEN round(round(red * 10000, 0) / 10000, 9) END AS red, CASE WHEN {_CLIP} THEN round(round(nir * 10000, 0) / 10000, 9) END AS nir FROM pixels WHERE {_WINDOW}",
    "drone_bands_clip": f"WITH {RGB_SQL} SELECT raster_id, px_row - 6 AS px_row, px_col - 6 AS px_col, CASE WHEN {_CLIP} AND r != 0 THEN round(r / 255e0, 9) END AS red, CASE WHEN {_CLIP} AND b != 0 THEN round(b / 255e0, 9) END AS blue FROM rgb WHERE {_WINDOW}",
    "drone_rgb_clip": f"WITH {RGB_SQL} SELECT raster_id, px_row - 6 AS px_row, px_col - 6 AS px_col, CASE WHEN {_CLIP} THEN r ELSE 0 END AS r, CASE WHEN {_CLIP} THEN g ELSE 0 END AS g, CASE WHEN {_CLIP} THEN b ELSE 0 END AS b FROM rgb WHERE {_WINDOW}",
    "raster_window": f"WITH {RGB_SQL} SELECT raster_id, px_row, px_col, g::double AS g, b::double AS b FROM rgb WHERE px_row BETWEEN 10 AND 29 AND px_col <= 20",
    "uploads": f"WITH {RGB_SQL}, f AS (SELECT raster_id AS k, max(px_row) + 1 AS h, max(px_col) + 1 AS w FROM rgb GROUP BY 1) SELECT k || CASE WHEN k % 3 = 0 THEN '.TIFF' ELSE '.tif' END AS name, 3 AS band_count, w::int AS width, h::int AS height, 'EPSG:32632' AS crs, 'uint8' AS dtype, 64 AS id_length FROM f WHERE k % 4 != 1 AND k % 5 != 2",
    "raster_resample": f"WITH {RGB_SQL}, w AS (SELECT i::int AS cell, p::int AS px, least((p + 1) * 0.4e0, i + 1) - greatest(p * 0.4e0, i) AS share FROM range(20) a(i), range(50) b(p) WHERE least((p + 1) * 0.4e0, i + 1) - greatest(p * 0.4e0, i) > 1e-9) SELECT raster_id, y.cell AS px_row, x.cell AS px_col, round(sum(r * y.share * x.share) / sum(y.share * x.share), 6) AS r, round(sum(g * y.share * x.share) / sum(y.share * x.share), 6) AS g, round(sum(b * y.share * x.share) / sum(y.share * x.share), 6) AS b FROM rgb JOIN w y ON y.px = px_row JOIN w x ON x.px = px_col GROUP BY 1, 2, 3",
    "preview_png": f"WITH {RGB_SQL} SELECT DISTINCT raster_id, 20 AS height, 20 AS width, 400::bigint AS opaque, 9e0 AS west, true AS upright FROM rgb",
    "export_geotiff": f"WITH {PIXELS_SQL}, v AS (SELECT boundary_id, ({_NDVI})::float::double AS v FROM pixels) SELECT boundary_id, count(v) AS n, round(sum(v), 3) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v GROUP BY 1",
    "raster_inspect": f"WITH {PIXELS_SQL} SELECT boundary_id, 1::int AS band_count, (max(px_col) + 1)::int AS width, (max(px_row) + 1)::int AS height, 'EPSG:4326' AS crs, 0.01e0 AS resolution, 7e0 AS minx, round(9.5e0 - 0.01e0 * (max(px_row) + 1), 6) AS miny, round(7e0 + 0.01e0 * (max(px_col) + 1), 6) AS maxx, 9.5e0 AS maxy, 'float32' AS dtype, 'nan' AS nodata FROM pixels GROUP BY 1",
    "plot_import": f"WITH {BOXES_SQL} SELECT boundary_id, (r * 3 + c)::int AS plot_id, r::int AS row_idx, c::int AS col_idx, round((maxx - minx) / 3 * (maxy - miny) / 2 * 111320e0 * (111320e0 * cos(radians(miny + (r + 0.5e0) * (maxy - miny) / 2))), 0) AS area_m2 FROM boxes, range(2) r(r), range(3) c(c)",
}
