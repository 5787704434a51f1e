"""Deterministic synthetic bands: reflectance that follows one smooth cover and one wetness over a boundary's box.

Two slow waves with hashed phases give every pixel a cover and a wetness in [0, 1]. A band runs over its value range from
bare to covered, dry to wet ground, with a hashed speckle on top.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions.spectral import clip

#: The range of each band.
RANGES = {"blue": (0.01, 0.2), "green": (0.02, 0.3), "red": (0.02, 0.4), "rededge": (0.05, 0.6), "nir": (0.05, 0.7), "swir1": (0.05, 0.5)}
#: How much of a band's range cover and wetness move it through (negative: downwards), and the speckle's share of the range.
SLOPES = {"blue": (-0.35, -0.1), "green": (-0.25, -0.1), "red": (-0.55, -0.1), "rededge": (0.45, 0.0), "nir": (0.7, -0.05), "swir1": (-0.25, -0.5)}
SPECKLE, WAVES = 0.04, 3


def _unit(*key: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)


def _field(seed: int, name: str, x: Column, y: Column) -> Column:
    """A smooth value in [0, 1]: the mean of WAVES plane waves whose direction, length and phase hash from the boundary."""
    total = F.lit(0.0)
    for k in range(WAVES):
        pick = lambda what, k=k: _unit(F.lit(seed), F.lit(f"{name}:{what}:{k}"), F.col("boundary_id"))
        turn = 2 * math.pi * pick("turn")
        total = total + F.sin(2 * math.pi * ((1 + 2 * pick("length")) * (x * F.cos(turn) + y * F.sin(turn)) + pick("phase")))
    return (total / WAVES + 1) / 2


def synthetic_bands(boundaries: DataFrame, resolution: int = 128, seed: int = 0) -> DataFrame:
    """Pixels of boundaries (boundary_id, ring): px_row, px_col, six bands, NULL outside the ring. Row 0 is the north."""
    b = boundaries.withColumn("_b", G.bounds(F.col("ring")))
    px = b.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(resolution * resolution - 1))))
    px = px.withColumns({"px_row": F.expr(f"_k div {resolution}").cast("int"), "px_col": (F.col("_k") % resolution).cast("int")})
    u, v = (F.col("px_col") + 0.5) / resolution, (F.col("px_row") + 0.5) / resolution
    x = F.col("_b.minx") + u * (F.col("_b.maxx") - F.col("_b.minx"))
    y = F.col("_b.maxy") - v * (F.col("_b.maxy") - F.col("_b.miny"))
    px = px.withColumns({"_in": G.inside(x, y, F.col("ring")), "_cover": _field(seed, "cover", u, v), "_wet": _field(seed, "wet", u, v)})

    def band(name: str) -> Column:
        (low, high), (cover, wet) = RANGES[name], SLOPES[name]
        at = sum((s * F.col(c) if s >= 0 else -s * (1 - F.col(c)) for s, c in ((cover, "_cover"), (wet, "_wet"))), F.lit(0.1))
        speckle = SPECKLE * (2 * _unit(F.lit(seed), F.lit(name), F.col("boundary_id"), F.col("px_row"), F.col("px_col")) - 1)
        return clip(low + (high - low) * (at + speckle), low, high)

    return px.select("boundary_id", "px_row", "px_col", *[F.when(F.col("_in"), band(n)).alias(n) for n in RANGES])
