"""Spectral indices and colour ramps as Columns; missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = 1e-8


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; NULL stays NULL (least and greatest would skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def safe_ratio(n: Column, d: Column) -> Column:
    """``n / d`` within [-1, 1]; a denominator nearer to 0 than EPSILON counts as +EPSILON."""
    return clip(n / F.when(F.abs(d) < EPSILON, F.lit(EPSILON)).otherwise(d), -1.0, 1.0)


def difference_ratio(a: Column, b: Column) -> Column:
    return safe_ratio(a - b, a + b)


@dataclass(frozen=True)
class Index:
    """``build`` takes one Column for each of ``bands``."""

    name: str
    bands: tuple[str, ...]
    build: Callable[..., Column]
    label: str
    ramp: str
    low: float
    high: float


#: Names, bands, labels, colour ramps and display ranges of the six indices.
INDICES: dict[str, Index] = {
    i.name: i
    for i in (
        Index("ndvi", ("red", "nir"), lambda red, nir: difference_ratio(nir, red), "NDVI (Vegetation)", "RdYlGn", -0.2, 0.9),
        Index("ndre", ("rededge", "nir"), lambda edge, nir: difference_ratio(nir, edge), "NDRE (Crop Vigor / Nitrogen)", "RdYlGn", -0.1, 0.6),
        Index("ndwi", ("green", "nir"), lambda green, nir: difference_ratio(green, nir), "NDWI (Surface Water)", "Blues", -0.3, 0.6),
        Index("ndmi", ("nir", "swir1"), lambda nir, swir: difference_ratio(nir, swir), "NDMI (Crop Water Stress)", "BrBG", -0.4, 0.5),
        Index("savi", ("red", "nir"), lambda red, nir: safe_ratio((nir - red) * 1.5, nir + red + 0.5), "SAVI (Soil-Adjusted Vegetation)", "RdYlGn", -0.2, 0.7),
        Index("evi", ("blue", "red", "nir"), lambda blue, red, nir: safe_ratio((nir - red) * 2.5, nir + red * 6.0 - blue * 7.5 + 1.0), "EVI (Enhanced Vegetation)", "RdYlGn", -0.2, 0.8),
    )
}

#: The three stops of each colour ramp.
RAMPS = {
    "RdYlGn": ((215, 48, 39), (255, 255, 191), (26, 152, 80)),
    "Blues": ((247, 251, 255), (107, 174, 214), (8, 48, 107)),
    "BrBG": ((140, 81, 10), (245, 245, 245), (1, 102, 94)),
}


def register_index(name: str, bands: tuple[str, ...], build: Callable[..., Column], label: str | None = None, ramp: str = "RdYlGn", low: float = -1.0, high: float = 1.0) -> Index:
    """Add an index of one's own; it then works wherever a name is taken."""
    INDICES[name] = Index(name, tuple(bands), build, label or name.upper(), ramp, low, high)
    return INDICES[name]


def index_of(name: str) -> Index:
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; known: {sorted(INDICES)}")
    return INDICES[name]


def index_column(name: str, columns: dict[str, Column] | None = None) -> Column:
    """The index over the band columns of the same names, or over those given."""
    spec = index_of(name)
    missing = [b for b in spec.bands if columns is not None and b not in columns]
    if missing:
        raise ValueError(f"{name} needs the bands {missing}")
    return spec.build(*[columns[b] if columns else F.col(b) for b in spec.bands])


def colorize(value: Column, ramp: str, low: float, high: float) -> dict[str, Column]:
    """Columns r, g, b, a of a three-stop ramp; NULL is transparent black. An unknown ramp is RdYlGn."""
    first, middle, last = RAMPS.get(ramp, RAMPS["RdYlGn"])
    t = clip((value - low) / (high - low), 0.0, 1.0)

    def channel(k: int) -> Column:
        below = first[k] + (middle[k] - first[k]) * (t / 0.5)
        above = middle[k] + (last[k] - middle[k]) * ((t - 0.5) / 0.5)
        return F.coalesce(F.floor(F.when(t < 0.5, below).otherwise(above)).cast("int"), F.lit(0))

    return {"r": channel(0), "g": channel(1), "b": channel(2), "a": F.when(value.isNull(), 0).otherwise(255)}


def registry(spark: SparkSession) -> DataFrame:
    rows = [(i.name, i.label, list(i.bands), i.low, i.high) for i in INDICES.values()]
    return spark.createDataFrame(rows, "name string, label string, bands array<string>, low double, high double")


def excess_green(r: Column, g: Column, b: Column, brightest: Column) -> Column:
    """2g - r - b; channels are scaled by 255 if the raster's largest value is above 1."""
    scale = F.when(brightest > 1, F.lit(255.0)).otherwise(F.lit(1.0))
    return 2 * (g / scale) - r / scale - b / scale
