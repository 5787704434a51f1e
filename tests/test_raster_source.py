"""Windowed reads, the raster source and the sink of files."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.sources import raster_source, rasters, store, tiff


def tiled(a: np.ndarray, side: int, planar: bool, order: str = "<") -> bytes:
    """Deflated tiles, in planes or interleaved."""
    n, h, w = a.shape
    down, across = -(-h // side), -(-w // side)
    whole = np.zeros((n, down * side, across * side), a.dtype)
    whole[:, :h, :w] = a
    cell = lambda r, c: whole[:, r * side : (r + 1) * side, c * side : (c + 1) * side]
    cells = [cell(r, c) for r in range(down) for c in range(across)]
    blocks = [x[k] for k in range(n) for x in cells] if planar else [np.moveaxis(x, 0, 2) for x in cells]
    packed = [zlib.compress(np.ascontiguousarray(b).astype(a.dtype.newbyteorder(order)).tobytes()) for b in blocks]
    spots = [8 + sum(map(len, packed[:k])) for k in range(len(packed))]
    body = b"".join(packed)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (a.dtype.itemsize * 8,) * n), (259, 3, (8,)), (277, 3, (n,)), (284, 3, (2 if planar else 1,)), (322, 3, (side,)), (323, 3, (side,)), (324, 4, spots), (325, 4, [len(p) for p in packed]), (339, 3, (kind,) * n)]
    assert order == "<"
    return tiff._with_directory(body, tags)


@pytest.mark.parametrize("kind", ["planar", "interleaved", "strips", "lzw"])
def test_windows_equal_slices(tmp_path, kind):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 60_000, (3, 70, 45)).astype("<u2")
    if kind == "lzw":
        a = rng.random((1, 70, 45)).astype("<f4")
    raw = {"planar": lambda: tiled(a, 16, True), "interleaved": lambda: tiled(a, 16, False), "strips": lambda: tiff.write_bands(a, 0, 0, 1, 1), "lzw": lambda: tiff.write_band(a[0], 0, 0, 1, 1)}[kind]()
    path = tmp_path / "a.tif"
    path.write_bytes(raw)
    assert np.array_equal(tiff.read_bands(raw), a)
    for _ in range(30):
        r0, c0 = rng.integers(0, 70), rng.integers(0, 45)
        h, w = rng.integers(0, 71 - r0), rng.integers(0, 46 - c0)
        bands = [1] if kind == "lzw" else list(rng.permutation([1, 2, 3])[: rng.integers(1, 4)])
        want = a[np.array(bands) - 1, r0 : r0 + h, c0 : c0 + w]
        for data in (raw, store.Ranged(str(path)), store.Ranged(f"file:{path}")):
            assert np.array_equal(tiff.read_window(data, [int(b) for b in bands], int(r0), int(c0), int(h), int(w)), want)
    with pytest.raises(ValueError, match="bands"):
        tiff.read_window(raw, [4])


def test_headers_and_windows_read_few_bytes(tmp_path):
    a = np.random.default_rng(2).integers(0, 65_536, (4, 1_500, 1_200)).astype("<u2")
    path = tmp_path / "large.tif"
    path.write_bytes(tiled(a, 128, True))
    assert path.stat().st_size > 12_000_000
    file = store.Ranged(str(path))
    assert tiff.describe(file)["band_count"] == 4 and file.bytes_read <= 64 << 10
    before = file.bytes_read
    assert np.array_equal(tiff.read_window(file, [3], 300, 500, 40, 40), a[2:3, 300:340, 500:540])
    assert file.bytes_read - before < 200_000  # blocks of one band


def test_one_large_raster_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(3).integers(1, 250, (2, 300, 260)).astype("u1")
    (tmp_path / "one.tif").write_bytes(tiled(a, 32, True))
    monkeypatch.setattr(rasters, "TILE", 4_096)
    files = spark.createDataFrame([("one", str(tmp_path / "one.tif"))], "id string, path string")
    window = rasters.windows(files, None, "id")
    cut = rasters.tiles(window).collect()
    assert len(cut) > 15 and sum(t.tile_height * t.tile_width for t in cut) == 300 * 260
    rows = rasters.clipped(files, window, "id", {"x": 2}).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 4
    got = np.zeros((300, 260))
    for r in rows.collect():
        got[r.px_row, r.px_col] = r.x
    assert np.array_equal(got, a[1])


def test_paths_and_bytes_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "TILE", 512)
    rng = np.random.default_rng(4)
    rows = []
    for scene in (1, 2):
        for role in ("red", "nir"):
            raw = tiff.write_bands(rng.integers(0, 9_000, (1, 60, 50)).astype("<u2"), 500_000.0, 1_000_000.0, 10.0, 10.0, 32632)
            (tmp_path / f"{scene}-{role}.tif").write_bytes(raw)
            rows.append((scene, role, raw, f"file:{tmp_path}/{scene}-{role}.tif"))
    assets = spark.createDataFrame(rows, "scene_id long, role string, data binary, path string")
    corner = lambda x, y: G.to_wgs84(F.lit(500_000.0 + 10 * x), F.lit(1_000_000.0 - 10 * y), "EPSG:32632")
    fields = assets.select("scene_id").distinct().withColumn("ring", F.array(corner(5, 8), corner(44, 12), corner(30, 55), corner(7, 40)))
    by_bytes, by_path = (rasters.scene_bands(assets.drop(c), fields, ["red", "nir"]) for c in ("path", "data"))
    assert by_bytes[0].exceptAll(by_path[0]).count() == by_path[0].exceptAll(by_bytes[0]).count() == 0 < by_path[0].where("red IS NOT NULL").count()
    assert by_bytes[1].collect() == by_path[1].collect()
    with pytest.raises(ValueError, match="missing required band 'blue'"):
        rasters.scene_bands(assets.drop("data"), fields, ["red", "blue"])


def test_raster_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster_source, "TILE", 2_048)
    rng = np.random.default_rng(5)
    bands = {n: rng.integers(0, 255, (3, 90, 70)).astype("u1") for n in ("a", "b")}
    for n, v in bands.items():
        (tmp_path / f"{n}.tif").write_bytes(tiled(v, 16, False))
    (tmp_path / "note.txt").write_text("no raster")
    df = raster_source.registered(spark).read.format("fieldloom_raster").option("path", str(tmp_path)).option("bands", "x:3,y:1").load()
    assert df.count() == 2 * 90 * 70
    some = df.where("px_row >= 20 AND px_row < 33 AND px_col = 40 AND x >= 0").where(F.col("path") == f"{tmp_path}/b.tif")
    left = [x for x in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert "x#" in left[0] and not any(n in left[0].split("RelationV2")[0] for n in ("px_row", "px_col", "path"))  # those are the source's
    assert sorted((r.px_row, r.x, r.y) for r in some.collect()) == [(k, float(bands["b"][2, k, 40]), float(bands["b"][0, k, 40])) for k in range(20, 33)]
    assert df.where("px_row > 500").count() == 0 == df.where("px_row < 0").count()
    reader = raster_source.RasterReader(str(tmp_path), {"x": 3})
    whole = len(reader.partitions())
    reader.low["px_row"], reader.high["px_row"] = 0, 5
    assert 0 < len(reader.partitions()) < whole


def test_sink(spark, tmp_path):
    folder = str(tmp_path / "out")
    files = lambda *rows: spark.createDataFrame(list(rows), "name string, data binary")
    listed = store.put(files(("a.bin", b"one"), ("b.bin", None), ("c.bin", b"x" * 100_000)).repartition(3), folder)
    assert sorted((r.name, r.length) for r in listed.collect()) == [("a.bin", 3), ("c.bin", 100_000)] and os.path.getsize(f"{folder}/b.bin") == 0
    store.put(files(("a.bin", b"two"), ("d.bin", b"")), folder)
    assert sorted(os.listdir(folder)) == ["a.bin", "b.bin", "c.bin", "d.bin"] and open(f"{folder}/a.bin", "rb").read() == b"two"
    for bad in (files(("e.bin", b"1"), ("x/y", b"2")).repartition(2), files(("f.bin", b"1"), ("f.bin", b"2")).repartition(2), files(("g.bin", b"1"), (None, b"2"))):
        with pytest.raises(Exception):  # noqa: B017  a task or the commit raises
            store.put(bad, folder)
        assert sorted(os.listdir(folder)) == ["a.bin", "b.bin", "c.bin", "d.bin"]
    store.put(files(("z.bin", b"9")), folder, overwrite=True)
    assert os.listdir(folder) == ["z.bin"]
    store.put(files(), folder)
    assert os.listdir(folder) == ["z.bin"]
