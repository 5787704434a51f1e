"""Zipped shapefiles of polygons, and KML placemarks."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_FEATURES = "ordinal int, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>, prj string"


def _oriented(ring: list[tuple[float, float]], clockwise: bool) -> list[tuple[float, float]]:
    pts = ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:]))
    return pts[::-1] if (area > 0) == clockwise else pts


def write_zip(features: list[tuple[list[list[tuple[float, float]]], dict[str, str]]], layer: str = "layer", prj: str = WGS84) -> bytes:
    """A zip of .shp, .shx, .dbf, .prj and .cpg; the first ring of a feature is its outer one."""
    records, index, at = bytearray(), bytearray(), 50
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for k, (rings, _) in enumerate(features, 1):
        parts = [_oriented(r, j == 0) for j, r in enumerate(rings)]
        pts = [p for r in parts for p in r]
        xs, ys = [p[0] for p in pts] or [0.0], [p[1] for p in pts] or [0.0]
        own = (min(xs), min(ys), max(xs), max(ys))
        box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        starts = [sum(map(len, parts[:j])) for j in range(len(parts))]
        body = struct.pack("<i4d2i", 5, *own, len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        records += struct.pack(">2i", k, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    if not features:
        box = [0.0] * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i4d4d", 1000, 5, *box, 0, 0, 0, 0)
    names = list(dict.fromkeys(n for _, a in features for n in a)) or ["id"]
    width = {n: min(254, max([1, *(len((a.get(n) or "").encode()) for _, a in features)])) for n in names}
    size = 1 + sum(width.values())
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(features), 33 + 32 * len(names), size)
    dbf += b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", width[n], 0) for n in names) + b"\r"
    dbf += b"".join(b" " + b"".join((a.get(n) or "").encode()[: width[n]].ljust(width[n]) for n in names) for _, a in features) + b"\x1a"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for suffix, data in (("shp", head(len(records)) + records), ("shx", head(len(index)) + index), ("dbf", dbf), ("prj", prj.encode()), ("cpg", b"UTF-8")):
            z.writestr(zipfile.ZipInfo(f"{layer}.{suffix}"), bytes(data))
    return out.getvalue()


def read_zip(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]], dict[str, str], str | None]]:
    """Polygon features of the first .shp, or of a bare .shp file: ordinal among polygons, rings, attributes, projection text."""
    if data[:4] == b"\0\0\x27\x0a":
        return _features(data, [], None)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shp = next((n for n in sorted(z.namelist()) if n.lower().endswith(".shp")), None)
        if shp is None:
            raise ValueError("the zip has no .shp")
        member = {n.lower(): n for n in z.namelist()}
        part = lambda s: z.read(member[shp[:-4].lower() + s]) if shp[:-4].lower() + s in member else None
        raw, dbf, prj = z.read(shp), part(".dbf"), part(".prj")
    rows: list[dict[str, str]] = []
    if dbf:
        count, start, size = struct.unpack("<IHH", dbf[4:12])
        fields, at = [], 32
        while dbf[at] != 13:
            fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
            at += 32
        for k in range(count):
            o, row = start + k * size + 1, {}
            for name, width in fields:
                row[name] = dbf[o : o + width].decode("utf-8", "replace").strip()
                o += width
            rows.append(row)
    return _features(raw, rows, prj.decode() if prj else None)


def _features(raw: bytes, rows: list[dict[str, str]], prj: str | None) -> list[tuple[int, list[list[tuple[float, float]]], dict[str, str], str | None]]:
    """Polygon records of a .shp; ``rows`` are the attributes of all its records."""
    out, at, k = [], 100, 0
    while at + 8 <= len(raw):
        size = struct.unpack(">2i", raw[at : at + 8])[1] * 2
        body = raw[at + 8 : at + 8 + size]
        if struct.unpack("<i", body[:4])[0] % 10 == 5:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            pts = list(zip(flat[::2], flat[1::2]))
            out.append((len(out), [pts[a:b] for a, b in zip(starts, starts[1:])], rows[k] if k < len(rows) else {}, prj))
        at, k = at + 8 + size, k + 1
    return out


def export_shapefile(features: DataFrame, group: str, rings: str, attributes: list[str], layer: str = "layer", order: str | None = None) -> DataFrame:
    """(group, data): one zip per group; ``rings`` is an array of rings in EPSG:4326."""
    kind = features.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order) if order else pdf
        items = [([[(p["x"], p["y"]) for p in ring] for ring in row[rings]], {a: "" if pd.isna(row[a]) else str(row[a]) for a in attributes}) for _, row in pdf.iterrows()]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "data": [write_zip(items, layer)]})

    return features.select(*dict.fromkeys([group, rings, *attributes, *([order] if order else [])])).groupBy(group).applyInPandas(one, f"{group} {kind}, data binary")


def read_shapefiles(files: DataFrame, key: str, data: str = "data") -> DataFrame:
    """Polygon features of a table of zipped shapefiles."""
    kind = files.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, [[{"x": x, "y": y} for x, y in ring] for ring in rings], a, prj) for k, d in zip(b[key], b[data]) for i, rings, a, prj in read_zip(bytes(d))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "rings", "attributes", "prj"])

    return files.select(key, data).mapInPandas(scan, f"{key} {kind}, {_FEATURES}")


def _first_of(attributes: Column, names: tuple[str, ...]) -> Column:
    lower = F.transform_keys(attributes, lambda k, v: F.lower(k))
    return F.coalesce(*[F.try_element_at(lower, F.lit(n)) for n in names]).try_cast("int")


#: Attribute names that may hold a plot's row and column, the first that is there counts.
ROW_NAMES = ("row", "row_idx", "row_id", "plot_row")
COL_NAMES = ("col", "col_idx", "col_id", "plot_col", "column")


def imported_plots(features: DataFrame, key: str) -> DataFrame:
    """Plots of imported features: plot_id is the ordinal; row and column from attributes, else row 0 and the ordinal."""
    row, col = _first_of(F.col("attributes"), ROW_NAMES), _first_of(F.col("attributes"), COL_NAMES)
    both = row.isNotNull() & col.isNotNull()
    latitude = G.centroid(F.col("rings")[0])["y"]
    area = G.rint(G.metric_area(G.polygon_area(F.col("rings")), latitude), 2)
    return features.select(key, F.col("ordinal").alias("plot_id"), F.when(both, row).otherwise(0).alias("row_idx"), F.when(both, col).otherwise(F.col("ordinal")).alias("col_idx"), "rings", area.alias("area_m2"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a polygon: name and outer ring, by Spark's own XML reader."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    text = F.regexp_replace(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+", " ")
    point = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    return raw.where(F.col("Polygon").isNotNull()).select("name", F.transform(F.split(text, " "), point).alias("ring"))
