"""Geometry as Columns: rings are ``array<struct<x double, y double>>``, closed or not.

Plane algorithms (shoelace area and centroid, even-odd test, rectangle clip) are expressions that stay in the JVM;
those that reorder vertices are in ``kernels``.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
RING = "array<struct<x:double,y:double>>"
GEOJSON = "struct<type:string,coordinates:string>"


def rint(x: Column, digits: int) -> Column:
    """Scaled, rounded half to even, unscaled."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _edges(ring: Column) -> Column:
    """(a, b) of each side, the closing one included."""

    def sides(r: Column) -> Column:
        return F.transform(r, lambda p, i: F.struct(p.alias("a"), F.element_at(r, (i + 1) % F.size(r) + 1).alias("b")))

    return let(ring, sides)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    cross = F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) >= 3, _total(cross) / 2).otherwise(0.0)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(rings: Column) -> Column:
    """First ring less the others (holes)."""
    return _total(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))))


def centroid(ring: Column) -> Column:
    """Struct (x, y); the mean of the vertices if the area is 0."""
    return let(ring, _centroid)


def _centroid(ring: Column) -> Column:
    part = lambda axis: _total(F.transform(_edges(ring), lambda e: (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])))
    mean = lambda axis: _total(F.transform(ring, lambda p: p[axis])) / F.nullif(F.size(ring).cast("double"), F.lit(0.0))
    six = F.nullif(signed_area(ring) * 6, F.lit(0.0))
    return F.struct(F.coalesce(part("x") / six, mean("x")).alias("x"), F.coalesce(part("y") / six, mean("y")).alias("y"))


def bounds(ring: Column) -> Column:
    return let(ring, _bounds)


def _bounds(ring: Column) -> Column:
    axis = lambda a: F.transform(ring, lambda p: p[a])
    return F.struct(F.array_min(axis("x")).alias("minx"), F.array_min(axis("y")).alias("miny"), F.array_max(axis("x")).alias("maxx"), F.array_max(axis("y")).alias("maxy"))


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if a ray to the right of (x, y) crosses the side: half-open in y, so a vertex counts once."""
    at = x1 + (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1)
    return F.when(((y1 > y) != (y2 > y)) & (x < at), 1).otherwise(0)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test."""
    n = F.aggregate(_edges(ring), F.lit(0), lambda s, e: s + crosses(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return n % 2 == 1


def on_edge(x: Column, y: Column, ring: Column) -> Column:
    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(_edges(ring), touches)


def strictly_inside(x: Column, y: Column, ring: Column) -> Column:
    """Inside, and not on the boundary."""
    return inside(x, y, ring) & ~on_edge(x, y, ring)


def metric_area(area_degrees: Column, latitude: Column) -> Column:
    """Square metres of an area in square degrees, by the local approximation."""
    return area_degrees * METRES_PER_DEGREE * (METRES_PER_DEGREE * F.cos(F.radians(latitude)))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy))


def clip_to_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Ring within an axis-parallel rectangle, side by side: the area is exact, parts of a concave ring stay joined."""

    def half(points: Column, axis: str, bound: Column, keep_above: bool) -> Column:
        ok = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound
        other = "y" if axis == "x" else "x"

        def cut(e: Column) -> Column:
            a, b = e["a"], e["b"]
            t = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
            at = a[other] + t * (b[other] - a[other])
            point = F.struct(*[(bound if c == axis else at).alias(c) for c in ("x", "y")])
            none = F.array().cast(RING)
            return F.concat(F.when(ok(a) != ok(b), F.array(point)).otherwise(none), F.when(ok(b), F.array(b)).otherwise(none))

        return let(points, lambda p: F.flatten(F.transform(_edges(p), cut)))

    for axis, bound, above in (("x", minx, True), ("x", maxx, False), ("y", miny, True), ("y", maxy, False)):
        ring = half(ring, axis, bound, above)
    return ring


def pixel_to_map(row: Column, col: Column, affine: Column, anchor: str = "centre") -> Column:
    """Map coordinates of a pixel's centre or corner under ``struct<a, b, c, d, e, f>``."""
    if anchor not in ("centre", "corner"):
        raise ValueError("anchor is centre or corner")
    shift = 0.5 if anchor == "centre" else 0.0
    x, y = col + shift, row + shift
    return F.struct((affine["a"] * x + affine["b"] * y + affine["c"]).alias("x"), (affine["d"] * x + affine["e"] * y + affine["f"]).alias("y"))


# Transverse Mercator by the Krueger series (public, to third order in n), WGS84.
_A, _FLAT = 6_378_137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_SCALE, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _zone(crs: str) -> tuple[float, float]:
    """Central meridian in radians and false northing of a UTM code."""
    code = crs.upper().removeprefix("EPSG:")
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return math.radians(int(code[3:]) * 6 - 183), _SOUTH if code[:3] == "327" else 0.0
    raise ValueError(f"unsupported reference system {crs}")


def to_wgs84(x: Column, y: Column, crs: str) -> Column:
    """Struct (x, y) in degrees from EPSG:4326, 3857, 326xx or 327xx."""
    code = crs.upper().removeprefix("EPSG:")
    if code == "4326":
        return F.struct(x.alias("x"), y.alias("y"))
    if code == "3857":
        return F.struct(F.degrees(x / _A).alias("x"), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2).alias("y"))
    meridian, north = _zone(crs)
    xi, eta = (y - north) / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    for j, b in enumerate(_BETA, 1):
        base_xi, base_eta = (y - north) / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
        xi = xi - b * F.sin(2 * j * base_xi) * F.cosh(2 * j * base_eta)
        eta = eta - b * F.cos(2 * j * base_xi) * F.sinh(2 * j * base_eta)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct(F.degrees(meridian + F.atan2(F.sinh(eta), F.cos(xi))).alias("x"), F.degrees(lat).alias("y"))


def from_wgs84(lon: Column, lat: Column, crs: str) -> Column:
    """Struct (x, y) in a projected system from degrees."""
    code = crs.upper().removeprefix("EPSG:")
    if code == "4326":
        return F.struct(lon.alias("x"), lat.alias("y"))
    if code == "3857":
        return F.struct((F.radians(lon) * _A).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * _A).alias("y"))
    meridian, north = _zone(crs)
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, away = F.radians(lat), F.radians(lon) - meridian
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    up, out = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        up = up + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        out = out + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((_EAST + _SCALE * _RADIUS * out).alias("x"), (north + _SCALE * _RADIUS * up).alias("y"))


def ring_to_wgs84(ring: Column, crs: Column, codes: list[str]) -> Column:
    """A ring in degrees from the reference system that ``crs`` names, one of ``codes``; NULL for another."""
    return _moved(ring, crs, codes, to_wgs84)


def ring_from_wgs84(ring: Column, crs: Column, codes: list[str]) -> Column:
    """A ring in degrees in the reference system that ``crs`` names, one of ``codes``; NULL for another."""
    return _moved(ring, crs, codes, from_wgs84)


def _moved(ring: Column, crs: Column, codes: list[str], move) -> Column:
    out = F.lit(None).cast(RING)
    for code in codes:
        out = F.when(crs == code, F.transform(ring, partial(_point, move, code))).otherwise(out)
    return out


def _point(move, code: str, p: Column) -> Column:
    return move(p["x"], p["y"], code)
