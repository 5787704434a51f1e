"""Boundaries, plots, notes, shares and scenes as tables with an append-only change log.

Plain Parquet has no row-level update: every insert, edit and delete is an appended version, and the current table
is the last version of each key that isn't a delete. A replaced set first marks all current rows as deleted, so
that an empty new set empties it.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import geometry as G
from fieldloom.operators import rings


def current(log: DataFrame, key: list[str], version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The last version of each key, without deleted ones; of one version's rows of a key, one that isn't deleted counts."""
    last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version), deleted))
    return log.withColumn("_k", last).where(f"_k = 1 AND NOT {deleted}").drop("_k", version, deleted)


def replaced(now: DataFrame, new: DataFrame, group: str, version: int) -> DataFrame:
    """Log rows that delete a group's current rows and put the new ones in; ``group`` values come from ``new`` or are given by ``now``."""
    gone = now.withColumn("version", F.lit(version)).withColumn("deleted", F.lit(True))
    put = new.withColumn("version", F.lit(version + 1)).withColumn("deleted", F.lit(False))
    return gone.unionByName(put)


def existing(wanted: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose key is in the current table."""
    return wanted.join(now.select(*key).distinct(), key, "left_semi")


def require(wanted: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """``wanted``; a key that isn't in the current table raises LookupError."""
    lost = wanted.join(now.select(*key).distinct(), key, "left_anti").select(*key).limit(1).collect()
    if lost:
        raise LookupError(f"there is no {dict(lost[0].asDict())}")
    return wanted


def lookup(now: DataFrame, **key):
    """The row with this key, or None."""
    for name, value in key.items():
        now = now.where(F.col(name) == value)
    return next(iter(now.limit(1).collect()), None)


def export_name(kind: str, boundary_id: Column, suffix: str) -> Column:
    """File name of an export: its kind and the first 8 characters of the boundary's identifier."""
    return F.concat(F.lit(f"{kind}_"), F.substring(boundary_id.cast("string"), 1, 8), F.lit(f".{suffix}"))


def accepted(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a file name ends in one of ``suffixes`` (with their dots), in any case."""
    return F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def next_plot_id(plots: DataFrame) -> DataFrame:
    """The largest plot_id of each boundary and 1; 0 for none."""
    return plots.groupBy("boundary_id").agg((F.coalesce(F.max("plot_id"), F.lit(-1)) + 1).cast("long").alias("next_plot_id"))


def list_boundaries(boundaries: DataFrame) -> DataFrame:
    return boundaries.orderBy(F.desc("created_at"), "id")


def list_plots(plots: DataFrame, boundary_id) -> DataFrame:
    return plots.where(F.col("boundary_id") == boundary_id).select("plot_id", F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "area_m2").orderBy("plot_id")


def list_annotations(notes: DataFrame, boundary_id) -> DataFrame:
    return notes.where(F.col("boundary_id") == boundary_id).orderBy(F.desc("created_at"), "id")


def share_token() -> str:
    """A url-safe token of 12 random bytes."""
    return secrets.token_urlsafe(12)


def resolve_shares(links: DataFrame, boundaries: DataFrame, results: DataFrame) -> DataFrame:
    """Links whose boundary exists, with the stored result if there is one."""
    known = links.join(boundaries.select(F.col("id").alias("boundary_id"), "name"), "boundary_id")
    return known.join(results, ["boundary_id", "index_name"], "left")


def report_rows(boundaries: DataFrame, plots: DataFrame, statistics: DataFrame) -> DataFrame:
    """Name (with a fallback), number of plots and the field's statistics, for the report."""
    counts = plots.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("plot_count"))
    b = boundaries.select(F.col("id").alias("boundary_id"), F.coalesce("name", F.lit("Unnamed Farm")).alias("name"))
    return b.join(counts, "boundary_id", "left").join(statistics, "boundary_id", "left").withColumn("plot_count", F.coalesce("plot_count", F.lit(0).cast("long")))


def ingest_boundaries(raw: DataFrame, text: str = "geojson") -> DataFrame:
    """``raw`` with ring, area_ha, centroid, bounds and problem, from a Feature, FeatureCollection (its first) or geometry.

    The outer ring of the first polygon counts; holes reduce the area. Unreadable rows keep NULLs and say why.
    """
    def kind(doc: Column) -> Column:
        return F.get_json_object(doc, "$.type")

    t = F.col(text)
    geometry = F.coalesce(F.get_json_object(t, "$.features[0].geometry"), F.get_json_object(t, "$.geometry"), F.when(F.get_json_object(t, "$.coordinates").isNotNull(), t))
    coords = F.get_json_object(geometry, "$.coordinates")
    one = F.from_json(coords, "array<array<array<double>>>")
    many = F.from_json(coords, "array<array<array<array<double>>>>")
    polygons = F.when(kind(geometry) == "Polygon", F.array(one)).when(kind(geometry) == "MultiPolygon", many)
    points = lambda ring: F.transform(F.filter(ring, lambda p, i: (i == 0) | (i < F.size(ring) - 1) | (p != ring[0])), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = raw.withColumn("polygons", F.transform(polygons, lambda rings: F.transform(rings, points)))
    ring = F.try_element_at(F.try_element_at(F.col("polygons"), F.lit(1)), F.lit(1))
    rows = rows.withColumn("ring", ring)
    degrees = F.aggregate(F.transform("polygons", G.polygon_area), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("centroid", F.when(F.size("ring") >= 3, G.centroid(F.col("ring"))))
    area = F.when(F.size("ring") >= 3, G.metric_area(degrees, F.col("centroid.y")))
    problem = F.when(geometry.isNull(), "no geometry").when(~kind(geometry).isin("Polygon", "MultiPolygon"), "not a polygon").when(F.coalesce(F.size("ring") < 3, F.lit(True)), "empty polygon").when(area <= 0, "no area")
    problem = F.coalesce(problem, F.when(~F.coalesce(F.forall("polygons", lambda p: F.size(p) > 0), F.lit(False)), "empty polygon"), F.when(~_all_valid(F.col("polygons")), "sides cross or touch"))
    return rows.withColumns({"area_ha": G.rint(area / 10_000, 2), "bounds": F.when(F.size("ring") >= 3, G.bounds(F.col("ring"))), "problem": problem})


@F.arrow_udf(T.BooleanType())
def _all_valid(polygons: pa.Array) -> pa.Array:
    return pa.array((all(rings.is_valid(np.array([(p["x"], p["y"]) for p in ring or ()], float).reshape(-1, 2)) for polygon in x.as_py() or () for ring in polygon) for x in polygons), pa.bool_())


def scenes_from_items(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of a folder of catalog items (JSON, one item or a collection of items a file): id, date, cloud, platform, hrefs, footprint."""
    item = "struct<id:string,properties:struct<datetime:timestamp,`eo:cloud_cover`:double,platform:string>,assets:map<string,struct<href:string>>,geometry:struct<type:string,coordinates:string>>"
    files = spark.read.option("wholetext", True).text(path)
    one = F.from_json("value", item)
    many = F.from_json(F.get_json_object("value", "$.features"), f"array<{item}>")
    items = files.select(F.explode(F.coalesce(many, F.array(one))).alias("i")).where("i.id IS NOT NULL")
    coords = F.from_json("i.geometry.coordinates", "array<array<array<double>>>")
    ring = F.transform(coords[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    found = items.select(F.col("i.id").alias("scene_id"), F.col("i.properties.datetime").alias("date"), F.col("i.properties.eo:cloud_cover").alias("cloud_cover"), F.col("i.properties.platform").alias("platform"), F.col("i.assets.rendered_preview.href").alias("thumbnail_url"), F.transform_values("i.assets", lambda k, v: v["href"]).alias("hrefs"), ring.alias("ring"))
    return found.withColumn("_b", G.bounds(F.col("ring"))).select("*", "_b.*").drop("_b")


def search_scenes(scenes: DataFrame, start, end, max_cloud: float = 30.0, max_items: int | None = None, bbox: tuple[float, float, float, float] | None = None, polygon: list[tuple[float, float]] | None = None) -> DataFrame:
    """Scenes of a date range below a cloud cover, least cloud first; bounding boxes must meet ``bbox`` if given.

    With ``polygon`` the scenes' footprints must meet it: their ``ring``, or their boxes where they have none.
    """
    if polygon:
        xs, ys = zip(*polygon)
        bbox = bbox or (min(xs), min(ys), max(xs), max(ys))
    found = scenes.where((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)) & (F.col("cloud_cover") < max_cloud))
    if bbox:
        found = found.where((F.col("minx") <= bbox[2]) & (F.col("maxx") >= bbox[0]) & (F.col("miny") <= bbox[3]) & (F.col("maxy") >= bbox[1]))
    if polygon:
        own = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in polygon])
        box = G.box(*[F.col(c).cast("double") for c in ("minx", "miny", "maxx", "maxy")])
        found = found.where(rings.meet(F.coalesce("ring", box) if "ring" in scenes.columns else box, own))
    found = found.orderBy("cloud_cover", "scene_id")
    return found.limit(max_items) if max_items else found


#: Asset keys of the band roles.
ASSETS = {"blue": "B02", "green": "B03", "red": "B04", "rededge": "B05", "nir": "B08", "swir1": "B11"}


def scene_assets(hrefs: Column) -> Column:
    """Map of band role to href, of the assets that a scene has."""
    roles = F.create_map(*[F.lit(x) for kv in ASSETS.items() for x in kv])
    return F.map_filter(F.transform_values(roles, lambda role, key: F.try_element_at(hrefs, key)), lambda role, href: href.isNotNull())


def reflectance(dn: Column, scale: float = 10_000.0) -> Column:
    """Digital number to reflectance; 0 and NaN are missing."""
    x = dn.cast("double")
    return F.when(F.isnan(x) | (x == 0), None).otherwise(x) / scale


def require_aligned(fine: DataFrame, coarse: DataFrame, factor: int, keys: list[str]) -> None:
    """Raise ValueError if a raster's coarse grid isn't its fine one divided by ``factor``, or is missing."""
    size = lambda df, name, by: df.groupBy(*keys).agg(*[F.ceil((F.max(c) + 1) / by).alias(f"{name}_{c}") for c in ("px_row", "px_col")])
    both = size(fine, "fine", factor).join(size(coarse, "coarse", 1), keys, "left")
    odd = both.where("NOT (fine_px_row <=> coarse_px_row AND fine_px_col <=> coarse_px_col)").limit(1).collect()
    if odd:
        r = odd[0]
        raise ValueError(f"the bands of {[r[k] for k in keys]} differ in shape: {r['coarse_px_row']} x {r['coarse_px_col']}, not {r['fine_px_row']} x {r['fine_px_col']}")


def align_bands(fine: DataFrame, coarse: DataFrame, factor: int, band: str, keys: list[str], strict: bool = False) -> DataFrame:
    """Coarse band resampled to the fine grid by nearest pixel; ``strict``: grids that don't fit raise, else they give NULLs."""
    if strict:
        require_aligned(fine, coarse, factor, keys)
    low = coarse.select(*keys, F.col("px_row").alias("_r"), F.col("px_col").alias("_c"), band)
    on = fine.withColumns({"_r": F.floor(F.col("px_row") / factor).cast("int"), "_c": F.floor(F.col("px_col") / factor).cast("int")})
    return on.join(low, [*keys, "_r", "_c"], "left").drop("_r", "_c")
