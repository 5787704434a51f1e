"""Rasters as a data source: ``spark.read.format("fieldloom_raster")``, a partition for each tile.

Options: ``path`` (a folder, or one file) and ``bands`` ("red:1,nir:2"; only these are read). Conditions on px_row and px_col, and on
path, are pushed down: files and tiles that they rule out make no partition, and only blocks that a tile's window meets are
read. Planning reads the headers of the files by byte ranges, on the driver; for catalogs of many files use
``fieldloom.sources.rasters``, which reads headers in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from fieldloom.sources import tiff
from fieldloom.sources.store import Ranged, opened

#: Pixels of a partition, about.
TILE = 1 << 20


def bands_of(text: str) -> dict[str, int]:
    """Names and 1-based numbers of "red:1,nir:2"."""
    pairs = [x.split(":") for x in text.split(",")]
    return {name.strip(): int(number) for name, number in pairs}


@dataclass
class Tile(InputPartition):
    path: str
    row: int
    col: int
    height: int
    width: int


def cut(low: int, high: int, step: int) -> list[tuple[int, int]]:
    """[low, high) at the multiples of ``step``: starts and sizes."""
    starts = [low, *range((low // step + 1) * step, high, step)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], high])]


class RasterReader(DataSourceReader):
    def __init__(self, path: str, bands: dict[str, int]):
        self.path, self.bands, self.paths = path, bands, None
        self.low, self.high = {"px_row": 0, "px_col": 0}, {"px_row": None, "px_col": None}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of px_row and px_col with numbers, and of path with names; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                high = f.value + isinstance(f, (EqualTo, LessThanOrEqual)) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                self.low[name] = max(self.low[name], low)
                self.high[name] = high if self.high[name] is None else self.high[name] if high is None else min(high, self.high[name])
            elif name == "path" and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            elif not (isinstance(f, IsNotNull) and name in ("path", *self.low)):
                yield f

    def files(self) -> list[str]:
        from pyarrow import fs

        where, path = opened(self.path)
        if where.get_file_info(path).type == fs.FileType.File:
            return [self.path]
        found = where.get_file_info(fs.FileSelector(path))
        return sorted(f"{self.path.rstrip('/')}/{x.base_name}" for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith((".tif", ".tiff")))

    def partitions(self) -> list[Tile]:
        out = []
        for path in self.files():
            if self.paths is not None and path not in self.paths:
                continue
            t = tiff.parse_header(Ranged(path))
            (bh, bw), ends = tiff.block_size(t), {}
            for name, size in (("px_row", t[257][0]), ("px_col", t[256][0])):
                ends[name] = (min(self.low[name], size), size if self.high[name] is None else max(0, min(self.high[name], size)))
            wide = bw * max(1, min(-(-t[256][0] // bw), TILE // (bh * bw)))
            high = bh * max(1, TILE // (bh * wide))
            (r0, r1), (c0, c1) = ends["px_row"], ends["px_col"]
            if r0 < r1 and c0 < c1:
                out += [Tile(path, r, c, h, w) for r, h in cut(r0, r1, high) for c, w in cut(c0, c1, wide)]
        return out or [Tile("", 0, 0, 0, 0)]

    def read(self, tile: Tile) -> Iterator[pa.RecordBatch]:
        names = ["path", "px_row", "px_col", *self.bands]
        n = tile.height * tile.width
        if not n:
            return
        a = tiff.read_window(Ranged(tile.path), list(self.bands.values()), tile.row, tile.col, tile.height, tile.width).astype(float)
        row, col = np.divmod(np.arange(n), tile.width)
        place = [pa.array([tile.path] * n), pa.array((row + tile.row).astype(np.int32)), pa.array((col + tile.col).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*place, *[pa.array(x.ravel(), mask=np.isnan(x).ravel()) for x in a]], names)


class Rasters(DataSource):
    """Pixel rows (path, px_row, px_col, bands) of GeoTIFF files; NaN is NULL."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_raster"

    def schema(self) -> str:
        return "path string, px_row int, px_col int, " + ", ".join(f"{n} double" for n in bands_of(self.options["bands"]))

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], bands_of(self.options["bands"]))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known and its pushdown on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rasters)
    return spark
