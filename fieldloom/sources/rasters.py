"""Rasters from files to pixels in one step: a boundary in degrees is carried into each raster's own reference system, the
raster is cropped to it, pixels whose centres lie outside are missing, and digital numbers are scaled.

Files are rows (key, path) or (key, data). Of a path only byte ranges are read: the header, by one scan, then the blocks (strips or tiles) of
the wanted bands that the window meets. A window is cut along its file's blocks into tiles of about TILE pixels, which are
dealt to tasks, so one large raster is read by many; files given as bytes are decoded where they are. The mask is an
expression on pixel rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions.spectral import clip
from fieldloom.operators import ranks
from fieldloom.sources import reports, tiff
from fieldloom.storage import maybe_broadcast, written

#: Pixels of a tile that a task reads at once, about.
TILE = 1 << 18
#: Digital numbers of a scene's bands and of 8-bit and other drone bands are divided by these; longest side
#: of a preview.
SCENE_SCALE, BYTE_SCALE, WORD_SCALE, PREVIEW_SIDE = 10_000.0, 255.0, 65_535.0, 1_400


def windows(files: DataFrame, boundaries: DataFrame | None, key: str) -> DataFrame:
    """One row for each file, written, so headers are read once: its header, ring in its own system, and the window (row0, col0, height, width) that holds the ring.

    ``boundaries`` has the key and ring, in degrees; without it the window is the whole raster. A file whose raster the
    boundary doesn't meet raises.
    """
    head = tiff.inspect(files, key, blocks=True).withColumn("crs", F.coalesce("crs", F.lit("EPSG:4326")))
    head = head.withColumns({"step_x": (F.col("maxx") - F.col("minx")) / F.col("width"), "step_y": (F.col("maxy") - F.col("miny")) / F.col("height")})
    head = head.withColumnsRenamed({"width": "full_width", "height": "full_height"})
    if boundaries is None:
        whole = head.withColumns({"ring": F.lit(None).cast(G.RING), "row0": F.lit(0), "col0": F.lit(0), "height": F.col("full_height"), "width": F.col("full_width")})
        return written(whole, "raster-windows")
    head = written(head, "raster-headers")
    codes = [r["crs"] for r in head.select("crs").distinct().collect()]  # as many as there are reference systems
    rows = head.join(boundaries.select(key, "ring"), key).withColumn("ring", G.ring_from_wgs84(F.col("ring"), F.col("crs"), codes)).withColumn("_b", G.bounds(F.col("ring")))
    low = lambda x, n: F.greatest(F.lit(0), F.least(n, F.floor(F.round(x, 6)).cast("int")))
    high = lambda x, n: F.greatest(F.lit(0), F.least(n, F.ceil(F.round(x, 6)).cast("int")))
    rows = rows.withColumns({
        "row0": low((F.col("maxy") - F.col("_b.maxy")) / F.col("step_y"), F.col("full_height")), "col0": low((F.col("_b.minx") - F.col("minx")) / F.col("step_x"), F.col("full_width")),
        "_r1": high((F.col("maxy") - F.col("_b.miny")) / F.col("step_y"), F.col("full_height")), "_c1": high((F.col("_b.maxx") - F.col("minx")) / F.col("step_x"), F.col("full_width")),
    })
    rows = rows.withColumns({"height": F.col("_r1") - F.col("row0"), "width": F.col("_c1") - F.col("col0")}).drop("_r1", "_c1", "_b")
    met = (F.col("height") > 0) & (F.col("width") > 0)
    return written(rows.withColumn("height", F.when(met, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("the boundary doesn't meet raster "), F.col(key).cast("string"))).cast("int"))), "raster-windows")


def affine(window: DataFrame, key: str) -> DataFrame:
    """(key, crs, affine, height, width) of the cropped rasters; ``affine`` maps (column, row) corners to coordinates."""
    zero = F.lit(0.0)
    a = F.struct(F.col("step_x").alias("a"), zero.alias("b"), (F.col("minx") + F.col("col0") * F.col("step_x")).alias("c"), zero.alias("d"), (-F.col("step_y")).alias("e"), (F.col("maxy") - F.col("row0") * F.col("step_y")).alias("f"))
    return window.select(key, "crs", a.alias("affine"), "height", "width")


def tiles(window: DataFrame) -> DataFrame:
    """``window`` cut along its file's blocks: tile_row, tile_col, tile_height and tile_width, from the window's corner."""
    wide = F.col("block_width") * F.greatest(F.lit(1), F.least(F.ceil(F.col("full_width") / F.col("block_width")), F.floor(TILE / (F.col("block_height") * F.col("block_width"))))).cast("int")
    high = F.col("block_height") * F.greatest(F.lit(1), F.floor(TILE / (F.col("block_height") * F.col("_wide")))).cast("int")
    cut = window.withColumn("_wide", wide).withColumn("_high", high)
    for at, size, step, out in (("row0", "height", "_high", "row"), ("col0", "width", "_wide", "col")):
        first, last = F.floor(F.col(at) / F.col(step)), F.floor((F.col(at) + F.col(size) - 1) / F.col(step))
        cut = cut.withColumn("_k", F.explode(F.sequence(first, last)))
        low, high = F.greatest(F.col(at), F.col("_k") * F.col(step)), F.least(F.col(at) + F.col(size), (F.col("_k") + 1) * F.col(step))
        cut = cut.withColumns({f"tile_{out}": (low - F.col(at)).cast("int"), f"tile_{size}": (high - low).cast("int")})
    return cut.drop("_k", "_wide", "_high")


def _dealt(rows: DataFrame, source: str, key: str) -> DataFrame:
    """Tiles of files that are read by path, dealt to tasks; files given as bytes are one tile."""
    if source == "path":  # a stated number: rows are short, so adaptive execution would put them all into one task
        return tiles(rows).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "tile_row", "tile_col")
    return rows.withColumns({"tile_row": F.lit(0), "tile_col": F.lit(0), "tile_height": F.col("height"), "tile_width": F.col("width")})


def _grid(height: int, width: int, row: int, col: int) -> dict[str, np.ndarray]:
    r, c = np.divmod(np.arange(height * width), width)
    return {"px_row": (r + row).astype(np.int32), "px_col": (c + col).astype(np.int32)}


def _inside(geometry: str | None = None) -> Column:
    """Whether a pixel's centre is in its file's ring; ``geometry`` names a struct that has the file's columns."""
    at = (lambda n: F.col(f"{geometry}.{n}")) if geometry else F.col
    x = at("minx") + (at("col0") + F.col("px_col") + 0.5) * at("step_x")
    y = at("maxy") - (at("row0") + F.col("px_row") + 0.5) * at("step_y")
    return F.when(at("ring").isNull(), F.lit(True)).otherwise(G.inside(x, y, at("ring")))


def clipped(files: DataFrame, window: DataFrame, key: str, bands: dict[str, int]) -> DataFrame:
    """Pixels (key, px_row, px_col, bands, dtype, inside) of each file's window; ``bands`` is name to 1-based number.

    A number that a file doesn't have raises. ``inside`` says whether the pixel's centre is in the ring.
    """
    kind, source = files.schema[key].dataType.simpleString(), tiff.source_of(files)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, d, r0, c0, r, c, h, w in zip(*(b[n] for n in (key, source, "row0", "col0", "tile_row", "tile_col", "tile_height", "tile_width"))):
                try:
                    a = tiff.read_window(tiff.reader(d), list(bands.values()), r0 + r, c0 + c, h, w)
                except ValueError as e:
                    raise ValueError(f"raster {k}: {e}") from e
                yield pd.DataFrame({key: k, **_grid(h, w, r, c), **{n: a[i].astype(float).ravel() for i, n in enumerate(bands)}})

    size = ["row0", "col0", "height", "width", "full_width", "block_height", "block_width"]
    wanted = _dealt(files.select(key, source).join(window.select(key, *size), key), source, key)
    pixels = wanted.mapInPandas(scan, f"{key} {kind}, px_row int, px_col int, " + ", ".join(f"{n} double" for n in bands))
    geometry = window.select(key, "ring", "dtype", "minx", "maxy", "step_x", "step_y", "row0", "col0")
    placed = pixels.join(maybe_broadcast(geometry), key)  # a shuffle by key would put a large raster into one task
    return placed.select(key, "px_row", "px_col", *bands, "dtype", _inside().alias("inside"))


def _scaled(value: str, scale: Column, inside: Column | None = None) -> Column:
    """0, NaN and pixels outside are missing."""
    v = F.col(value)
    return F.when((F.col("inside") if inside is None else inside) & ~F.isnan(v) & (v != 0), v / scale)


def drone_bands(files: DataFrame, boundaries: DataFrame, key: str, band_map: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Pixels of a multispectral raster clipped to its boundary, in 0..1 by its sample type; and the cropped rasters' affines."""
    window = windows(files, boundaries, key)
    scale = F.when(F.col("dtype") == "uint8", BYTE_SCALE).otherwise(WORD_SCALE)
    return clipped(files, window, key, band_map).select(key, "px_row", "px_col", *[_scaled(n, scale).alias(n) for n in band_map]), affine(window, key)


def joint_stretch(pixels: DataFrame, key: str, values: list[str], wanted: Column | None = None) -> DataFrame:
    """``values`` from their 1st to their 99th percentile, over all of them together, onto 0..255, truncated.

    ``wanted`` says which rows are stretched; the others stay. Percentiles are interpolated over value counts.
    """
    wanted = F.lit(True) if wanted is None else wanted
    one = pixels.where(wanted).select(key, F.explode(F.array(*values)).alias("v"))
    ends = maybe_broadcast(ranks.quantiles(one, "v", key, [0.01, 0.99]))
    level = lambda n: F.floor(clip((F.col(n) - F.col("_p")[0]) / F.greatest(F.col("_p")[1] - F.col("_p")[0], F.lit(1e-6)), 0.0, 1.0) * 255.0)
    joined = pixels.join(ends, key, "left")
    return joined.withColumns({n: F.when(wanted, level(n)).otherwise(F.col(n)) for n in values}).drop("_p")


def drone_rgb(files: DataFrame, key: str, boundaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first three bands as r, g, b of 0..255, 0 outside the boundary if there is one; and the rasters' affines.

    Rasters of another sample type than 8 bits are stretched over all three bands together.
    """
    window = windows(files, boundaries, key)
    rgb = clipped(files, window, key, {"r": 1, "g": 2, "b": 3}).withColumns({c: F.when(F.col("inside"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0) for c in "rgb"})
    rgb = joint_stretch(rgb, key, ["r", "g", "b"], F.col("dtype") != "uint8")
    return rgb.select(key, "px_row", "px_col", *[F.col(c).cast("int").alias(c) for c in "rgb"]), affine(window, key)


def scene_bands(assets: DataFrame, boundaries: DataFrame, bands: list[str], key: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """One row for each pixel of a scene with its wanted ``bands``, clipped to its boundary and in reflectance; and the affines.

    ``assets`` has the key, role and path or data: one single-band file for each role. A scene without a wanted role, or whose clipped
    bands differ in shape, raises.
    """
    wanted = assets.where(F.col("role").isin(*bands))
    have = assets.select(key).distinct().join(wanted.groupBy(key).agg(F.collect_set("role").alias("have")), key, "left")
    lacks = have.where(F.coalesce(F.size("have"), F.lit(0)) < len(set(bands))).limit(1).collect()
    if lacks:
        raise ValueError(f"scene {lacks[0][key]} is missing required band '{next(b for b in bands if b not in (lacks[0]['have'] or []))}'")
    source = tiff.source_of(assets)
    files = wanted.select(F.concat_ws("/", F.col(key).cast("string"), "role").alias("file"), key, "role", source)
    window = windows(files, files.select("file", key).join(boundaries.select(key, "ring"), key), "file").join(files.select("file", key, "role"), "file")
    odd = window.groupBy(key).agg(F.countDistinct("height", "width").alias("shapes")).where("shapes > 1").limit(1).collect()
    if odd:
        raise ValueError(f"the bands of scene {odd[0][key]} differ in shape")
    # a scene's files in one row: all its bands of a tile are read by one task, and pixels come pivoted
    pick = lambda role, value: F.max(F.when(F.col("role") == role, value))
    geometry = F.struct("ring", "minx", "maxy", "step_x", "step_y", "row0", "col0")
    scenes = window.groupBy(key).agg(*[pick(b, geometry).alias(f"_at_{b}") for b in bands], *[pick(bands[0], F.col(n)).alias(n) for n in ("row0", "col0", "height", "width", "full_width", "block_height", "block_width")])
    sources = files.groupBy(key).agg(*[pick(b, F.col(source)).alias(f"_file_{b}") for b in bands])
    places = [F.struct(f"_at_{b}.row0", f"_at_{b}.col0").alias(f"_place_{b}") for b in bands]
    size = ["row0", "col0", "height", "width", "full_width", "block_height", "block_width"]
    rows = _dealt(sources.join(scenes.select(key, *size, *places), key), source, key)
    kind = assets.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                r, c, h, w = (int(row[f"tile_{n}"]) for n in ("row", "col", "height", "width"))
                read = {}
                for b in bands:
                    at = row[f"_place_{b}"]
                    read[b] = tiff.read_window(tiff.reader(row[f"_file_{b}"]), [1], int(at["row0"]) + r, int(at["col0"]) + c, h, w)[0].astype(float).ravel()
                yield pd.DataFrame({key: row[key], **_grid(h, w, r, c), **read})

    pixels = rows.mapInPandas(scan, f"{key} {kind}, px_row int, px_col int, " + ", ".join(f"{b} double" for b in bands))
    placed = pixels.join(maybe_broadcast(scenes.select(key, *[f"_at_{b}" for b in bands])), key)
    wide = placed.select(key, "px_row", "px_col", *[_scaled(b, F.lit(SCENE_SCALE), _inside(f"_at_{b}")).alias(b) for b in bands])
    return wide, affine(window.where(F.col("role") == bands[0]), key)


def resampled(pixels: DataFrame, values: list[str], shapes: DataFrame, key: str) -> DataFrame:
    """Area averages on a smaller grid: ``shapes`` has the key, height, width, out_height and out_width.

    A pixel that lies across several cells counts in each by the area of it that lies there. NULLs count nowhere.
    """
    p = pixels.join(shapes, key)

    def cells(at: str, size: str, out: str, name: str) -> Column:
        low = F.col(at) * F.col(out) / F.col(size)
        high = (F.col(at) + 1) * F.col(out) / F.col(size)
        ends = F.sequence(F.floor(low).cast("int"), F.least(F.col(out) - 1, F.ceil(F.round(high, 9)).cast("int") - 1))
        share = lambda k: F.least(high, k + 1) - F.greatest(low, k.cast("double"))
        return F.filter(F.transform(ends, lambda k: F.struct(k.alias("at"), share(k).alias("share"))), lambda s: s["share"] > 1e-9).alias(name)

    p = p.select("*", cells("px_row", "height", "out_height", "_rows")).select("*", cells("px_col", "width", "out_width", "_cols"))
    p = p.withColumn("_r", F.explode("_rows")).withColumn("_c", F.explode("_cols")).withColumn("_w", F.col("_r.share") * F.col("_c.share"))
    mean = lambda v: F.sum(F.col(v) * F.col("_w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))
    return p.groupBy(key, F.col("_r.at").alias("px_row"), F.col("_c.at").alias("px_col")).agg(*[mean(v).alias(v) for v in values])


def previews(files: DataFrame, key: str, side: int = PREVIEW_SIDE) -> DataFrame:
    """(key, png, overlay, west, south, east, north): an averaged picture of at most ``side`` pixels, and its bounds in degrees.

    One band is shown grey; two bands raise. Other sample types than 8 bits are stretched over the shown bands together.
    """
    window = windows(files, None, key)
    counts = {r["band_count"] for r in window.select("band_count").distinct().collect()}  # as many as there are kinds of files
    if 2 in counts:
        raise ValueError("a raster of two bands has no preview")
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest("height", "width"))
    shapes = window.select(key, "height", "width", F.greatest(F.lit(1), F.floor(F.col("height") * scale).cast("int")).alias("out_height"), F.greatest(F.lit(1), F.floor(F.col("width") * scale).cast("int")).alias("out_width"))
    parts = []
    for grey in (True, False):
        some = window.where(F.col("band_count") == 1 if grey else F.col("band_count") >= 3)
        if (1 in counts) if grey else max(counts, default=0) >= 3:
            px = clipped(files.join(some.select(key), key, "left_semi"), some, key, {"r": 1} if grey else {"r": 1, "g": 2, "b": 3})
            names = ["r"] if grey else ["r", "g", "b"]
            small = resampled(px.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}), names, shapes, key).join(some.select(key, "dtype"), key)
            small = joint_stretch(small, key, names, F.col("dtype") != "uint8")
            parts.append(small.select(key, "px_row", "px_col", *[F.coalesce(F.col("r" if grey else c), F.lit(0)).cast("int").alias(c) for c in "rgb"], F.lit(255).alias("a")))
    if not parts:
        raise ValueError("there are no rasters")
    made = reports.export_png(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), key)
    codes = [r["crs"] for r in window.select("crs").distinct().collect()]
    steps = [k / 20 for k in range(21)]
    between = lambda low, high, t: F.col(low) + t * (F.col(high) - F.col(low))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    edge = F.array(*[point(between("minx", "maxx", t), F.col(y)) for t in steps for y in ("miny", "maxy")], *[point(F.col(x), between("miny", "maxy", t)) for t in steps for x in ("minx", "maxx")])
    degrees = G.ring_to_wgs84(edge, F.col("crs"), codes)
    where = window.select(key, G.bounds(degrees).alias("_b")).select(key, F.col("_b.minx").alias("west"), F.col("_b.miny").alias("south"), F.col("_b.maxx").alias("east"), F.col("_b.maxy").alias("north"))
    return made.join(where, key)


def landed(uploads: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """Upload intake: (file_id, name, data, header...) of the uploads that are TIFF files by name and can be read.

    ``file_id`` is a digest of the name and the bytes, so a repeated upload lands once; unreadable files are left out.
    """
    suffix = uploads.where(F.lower(F.col(name)).rlike(r"\.tiff?$")).select(F.col(name).alias("name"), F.col(data).alias("data"))
    suffix = suffix.withColumn("file_id", F.sha2(F.concat(F.col("name").cast("binary"), F.lit(b"\0"), F.col("data")), 256)).dropDuplicates(["file_id"])
    kinds = tiff.HEADER.split(", ")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, d in zip(b["file_id"], b["name"], b["data"]):
                try:
                    rows.append((i, n, bytes(d), *(tiff.describe(bytes(d))[x.split()[0]] for x in kinds)))
                except Exception:  # noqa: BLE001  any unreadable file is refused
                    continue
            yield pd.DataFrame(rows, columns=["file_id", "name", "data", *(x.split()[0] for x in kinds)])

    return suffix.select("file_id", "name", "data").mapInPandas(scan, "file_id string, name string, data binary, " + tiff.HEADER)
