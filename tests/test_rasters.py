"""Rings, rasters from files, extraction and catalog: analytic fixtures and brute force."""

import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.operators import catalog, kernels, ranks, rings, vision, zones
from fieldloom.plans import catalogue
from fieldloom.sources import rasters, reports, shapefile, tiff

SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
BOW = np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)


def test_validity_and_repair():
    assert rings.is_valid(SQUARE) and rings.is_valid(np.vstack([SQUARE, SQUARE[:1]]))
    for bad in (BOW, SQUARE[:2], [(0, 0), (1, 1), (2, 2)], [(0, 0), (4, 0), (8, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)], [(0, 0), (1, np.nan), (2, 2)], []):
        assert not rings.is_valid(np.array(bad, float).reshape(-1, 2))
    assert [rings.area_of(p) for p in rings.repaired(BOW)] == [4.0] and rings.repaired(np.array([(0.0, 0), (1, 1), (2, 2)])) == []
    rng = np.random.default_rng(2)
    for _ in range(300):
        p = rng.integers(0, 6, (rng.integers(4, 9), 2)).astype(float)
        assert all(rings.is_valid(x) for x in rings.repaired(p))


def test_clip_in_parts():
    rng, seen = np.random.default_rng(1), 0
    for _ in range(150):
        n = rng.integers(5, 14)
        turn, away = np.sort(rng.random(n)) * 2 * np.pi, rng.random(n) * 3 + 0.5
        p = np.c_[np.cos(turn) * away, np.sin(turn) * away]
        if not rings.is_valid(p):
            continue
        (x0, x1), (y0, y1) = (sorted(rng.random(2) * 6 - 3) for _ in range(2))
        parts, q = rings.clip_parts(p, x0, y0, x1, y1), p
        for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):  # side by side, parts joined: the same area
            out = []
            for a, b in zip(np.roll(q, 1, axis=0), q):
                fa, fb = sign * (a[axis] - bound), sign * (b[axis] - bound)
                out += [a + (b - a) * (fa / (fa - fb))] if (fa >= 0) != (fb >= 0) else []
                out += [b] if fb >= 0 else []
            q = np.array(out).reshape(-1, 2)
        assert sum(abs(rings.area_of(x)) for x in parts) == pytest.approx(abs(rings.area_of(q)), abs=1e-9) and all(map(rings.is_valid, parts))
        seen += len(parts) > 1
    assert seen > 3


def test_simplifying_keeps_the_topology():
    rng = np.random.default_rng(4)
    turn = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    p = np.c_[np.cos(turn), np.sin(turn)] * (50 + 6 * rng.random((200, 1)))
    fewer = rings.simplified(p)
    assert rings.is_valid(fewer) and len(fewer) < len(p)
    thin = np.array([(0, 0), (10, 0.4), (20, 0), (20, 0.1), (10, 0.5), (0, 0.1)], float)
    assert rings.is_valid(rings.simplified(thin, 5.0))


def test_rings_that_meet():
    inner, far, touching = SQUARE / 4 + 1, SQUARE + 10, SQUARE + (4, 0)
    assert rings.meets_ring(SQUARE, inner) and rings.meets_ring(inner, SQUARE) and rings.meets_ring(SQUARE, touching) and not rings.meets_ring(SQUARE, far)
    corner = np.array([(5, 5), (7, 3), (7, 7)], float)
    assert not rings.meets_ring(np.array([(0, 0), (8, 0), (0, 8)], float) - (0.5, 0.5), corner)


def test_bad_boundaries_say_why(spark):
    rows = [[[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]], [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]], [[[0, 0], [1, 0], [1, 1], [0, 0]]], []]
    docs = spark.createDataFrame([(k, json.dumps({"type": "Polygon", "coordinates": c})) for k, c in enumerate(rows)], "id int, geojson string")
    got = [r.problem for r in catalog.ingest_boundaries(docs).orderBy("id").collect()]
    assert got[0] and got[1] == "sides cross or touch" and got[2] is None and got[3] == "empty polygon"


def ring_of(spark, key, value, corners):
    return spark.createDataFrame([(value, [{"x": float(x), "y": float(y)} for x, y in corners])], f"{key} long, ring array<struct<x:double,y:double>>")


def test_rasters_from_files(spark):
    a = np.arange(1, 61, dtype=np.uint16).reshape(1, 6, 10)
    files = spark.createDataFrame([(1, tiff.write_bands(np.concatenate([a, a * 2, a * 3]), 0.0, 6.0, 1.0, 1.0))], "id long, data binary")
    box = ring_of(spark, "id", 1, [(2, 1), (5.6, 1), (5.6, 4), (2, 4)])
    got, where = rasters.drone_bands(files, box, "id", {"red": 1, "nir": 3})
    rows = {(r.px_row, r.px_col): (r.red, r.nir) for r in got.collect()}
    meta = where.first()
    assert (meta.height, meta.width, meta.affine.c, meta.affine.f, meta.crs) == (3, 4, 2.0, 4.0, "EPSG:4326")
    assert rows[0, 0] == (pytest.approx(23 / 65535), pytest.approx(69 / 65535)) and rows[2, 3][0] == pytest.approx(46 / 65535) and len(rows) == 12
    narrow, _ = rasters.drone_bands(files, ring_of(spark, "id", 1, [(2, 1), (5.4, 1), (5.4, 4), (2, 4)]), "id", {"red": 1})
    assert {(r.px_row, r.px_col): r.red for r in narrow.collect()}[0, 3] is None
    with pytest.raises(Exception, match="has 3 bands, not 4"):
        rasters.drone_bands(files, box, "id", {"red": 4})[0].count()
    with pytest.raises(Exception, match="doesn't meet"):
        rasters.drone_bands(files, ring_of(spark, "id", 1, [(50, 50), (51, 50), (51, 51)]), "id", {"red": 1})[0].count()
    rgb, _ = rasters.drone_rgb(files, "id")
    values = np.concatenate([a, a * 2, a * 3]).ravel().astype(float)
    low, high = np.percentile(values, (1, 99))
    want = np.floor(np.clip((np.concatenate([a, a * 2, a * 3]) - low) / (high - low), 0, 1) * 255).astype(int)
    assert all((r.r, r.g, r.b) == tuple(want[:, r.px_row, r.px_col]) for r in rgb.collect())


def test_scene_bands_raise(spark):
    one = lambda n: tiff.write_bands(np.full((1, n, n), 500, np.uint16), 0.0, 6.0, 6.0 / n, 6.0 / n)
    box = ring_of(spark, "scene_id", 1, [(1, 1), (5, 1), (5, 5), (1, 5)])
    files = lambda **r: spark.createDataFrame([(1, k, one(n)) for k, n in r.items()], "scene_id long, role string, data binary")
    got, where = rasters.scene_bands(files(red=6, nir=6, blue=12), box, ["red", "nir"])
    assert got.where("red = 0.05 AND nir = 0.05").count() == 16 and where.first().height == 4
    with pytest.raises(ValueError, match="missing required band 'green'"):
        rasters.scene_bands(files(red=6), box, ["red", "green"])
    with pytest.raises(ValueError, match="differ in shape"):
        rasters.scene_bands(files(red=6, nir=12), box, ["red", "nir"])


def test_previews(spark):
    grey = np.arange(100, dtype=np.uint8).reshape(1, 10, 10)
    files = spark.createDataFrame([(1, tiff.write_bands(grey, 7.0, 9.0, 0.1, 0.1)), (2, tiff.write_bands(np.concatenate([grey] * 4), 7.0, 9.0, 0.1, 0.1))], "id long, data binary")
    got = {r.id: r for r in rasters.previews(files, "id", 5).collect()}
    image = reports.png_pixels(bytes(got[1].png))
    assert image.shape == (5, 5, 4) and image[0, 0].tolist() == [5, 5, 5, 255] and (got[1].west, got[1].south, got[1].east, got[1].north) == pytest.approx((7, 8, 8, 9))
    assert np.array_equal(reports.png_pixels(bytes(got[2].png)), image)
    with pytest.raises(ValueError):
        rasters.previews(spark.createDataFrame([(1, tiff.write_bands(np.concatenate([grey, grey]), 7.0, 9.0, 0.1, 0.1))], "id long, data binary"), "id")


def test_uploads(spark):
    data = tiff.write_bands(np.ones((1, 2, 2), np.uint8), 0.0, 0.0, 1.0, 1.0)
    up = spark.createDataFrame([("a.TIF", data), ("a.TIF", data), ("b.tiff", b"nothing"), ("c.png", data)], "name string, data binary")
    got = rasters.landed(up).collect()
    assert [(r.name, r.width, r.dtype) for r in got] == [("a.TIF", 2, "uint8")]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32", "float64"])
def test_written_bands_come_back(kind):
    a = (np.random.default_rng(3).random((3, 7, 5)) * 200).astype(kind)
    data = tiff.write_bands(a, 500.0, 900.0, 2.0, 2.0, 32632)
    assert np.array_equal(tiff.read_bands(data), a) and tiff.describe(data)["crs"] == "EPSG:32632" and tiff.describe(data)["dtype"] == str(np.dtype(kind))


def lloyd(v, centres):
    while True:
        zone = np.abs(v[:, None] - centres[None]).argmin(1)
        after = np.array([v[zone == k].mean() if (zone == k).any() else c for k, c in enumerate(centres)])
        if np.allclose(after, centres, atol=1e-12):
            return after, ((v - after[zone]) ** 2).sum()
        centres = after


def test_zones_are_the_optimum(spark):
    """As good as every way to cut the sorted values, and never worse than Lloyd's rounds from any of many starts."""
    rng = np.random.default_rng(11)
    groups = {1: np.concatenate([rng.normal(0, 1, 50), rng.normal(1.5, 0.3, 30), [40.0]]), 2: rng.exponential(1.0, 70), 3: rng.integers(0, 6, 90).astype(float), 4: np.array([5.0, 5.0, 7.0]), 5: np.array([1.0, 2.0])}
    px = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)] + [(1, -1, None)], "g long, i int, v double").repartition(3)
    got = {(r.g, r.i): r.zone for r in zones.classify(px, "v", "g", 3).collect()}
    assert got[1, -1] is None and got[5, 0] is None and [got[4, i] for i in range(3)] == [0, 0, 1]
    spread = lambda x: float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0
    for g in (1, 2, 3):
        v = groups[g]
        zone = np.array([got[g, i] for i in range(len(v))])
        mine = sum(spread(v[zone == z]) for z in range(3))
        u = np.sort(v)
        assert mine <= min(spread(u[:i]) + spread(u[i:j]) + spread(u[j:]) for i in range(1, len(u)) for j in range(i, len(u))) + 1e-9
        assert all(mine <= lloyd(v, rng.choice(v, 3, replace=False))[1] + 1e-9 for _ in range(40))
        assert max(v[zone == 0]) < min(v[zone == 1]) and max(v[zone == 1]) < min(v[zone == 2])
    coarse = {(r.g, r.i): r.zone for r in zones.classify(px.where("g = 2"), "v", "g", 3, cells=32).collect()}
    assert sum(coarse[2, i] != got[2, i] for i in range(70)) <= 3
    with pytest.raises(ValueError, match="values for 300 zones"):
        zones.classify(px, "v", "g", 300, few="raise")


def test_zones_settle(spark):
    """Lloyd's rounds from two starts, as the zone queries' SQL states them, in one task and in rounds of all tasks."""
    rng = np.random.default_rng(5)
    groups = {1: np.concatenate([rng.normal(0, 1, 50), rng.normal(1.5, 0.3, 30), [40.0]]), 2: rng.exponential(1.0, 70), 3: rng.integers(0, 6, 90).astype(float), 4: np.full(4, 2.5), 5: np.array([1.0, 2.0])}
    px = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)] + [(1, -1, None)], "g long, i int, v double").repartition(3)
    got = {(r.g, r.i): r.zone for r in zones.settle(px, "v", "g", 3).collect()}
    assert got[1, -1] is None and got[5, 0] is None and {got[4, i] for i in range(4)} == {0}
    for g in (1, 2, 3):
        v = groups[g]
        starts = (v.min() + np.ptp(v) * np.array([1, 3, 5]) / 6, v.mean() + v.std() * np.array([-1, 0, 1]))
        centres = min((lloyd(v, c) for c in starts), key=lambda found: round(found[1], 9))[0]
        assert [got[g, i] for i in range(len(v))] == np.abs(v[:, None] - centres[None]).argmin(1).tolist()
    assert {(r.g, r.i): r.zone for r in zones.settle(px, "v", "g", 3, cells=2).collect()} == got
    with pytest.raises(ValueError, match="values for 300 zones"):
        zones.settle(px, "v", "g", 300, few="raise")


def test_zone_query_follows_its_sql(spark, tmp_path):
    """On rasters whose optimum isn't where the rounds end."""
    import duckdb

    rng = np.random.default_rng(3)
    pd.DataFrame({"event_id": np.arange(20_000), "user_id": rng.integers(0, 5_000, 20_000), "event_type": rng.choice(["view", "error", "click"], 20_000)}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(f"SELECT boundary_id, px_row, px_col, zone FROM ({catalogue.ORACLES['zone_classify']})").fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["zone_classify"](spark, str(tmp_path)).select("boundary_id", "px_row", "px_col", "zone").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_order_statistics(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 400).astype(float), "c": np.array([2.5]), "d": np.full(50, 3.0)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r._p for r in ranks.quantiles(df, "v", "g", [0.01, 0.5, 0.99, 0.0, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, [0.01, 0.5, 0.99, 0.0, 1.0]).tolist(), rel=1e-12)


def test_distances_and_floods_across_tasks(spark):
    """Masks against brute force: open edges, columns and rasters without background, a raster without plants."""
    rng = np.random.default_rng(8)
    masks = {1: rng.random((23, 31)) < 0.85, 2: np.ones((5, 6), bool), 3: np.zeros((4, 4), bool), 4: np.ones((9, 40), bool), 5: rng.random((40, 40)) < 0.6}
    masks[4][3, 17] = False
    px = spark.createDataFrame([(g, int(r), int(c), bool(m[r, c])) for g, m in masks.items() for r, c in np.ndindex(m.shape)], "raster_id long, px_row int, px_col int, plant boolean").repartition(4)
    far = {(r.raster_id, r.px_row, r.px_col): r.d2 for r in vision.squared_distance(px).collect()}
    ids = {(r.raster_id, r.px_row, r.px_col): r.plant_id for r in vision.watershed(px).collect()}
    for g, m in masks.items():
        zeros = np.argwhere(~m)
        labels = kernels.watershed_labels(m, 8)
        for r, c in np.ndindex(m.shape):
            assert far[g, r, c] == (min(((zeros - (r, c)) ** 2).sum(1)) if len(zeros) else None)
            assert ids.get((g, r, c), 0) == labels[r, c]


def test_methods_of_extraction():
    class Segmenter:
        def __init__(self, reason):
            self.reason = reason

        def __call__(self, rgb):
            return []

        def probe(self):
            if self.reason == "broken":
                raise OSError("no weights")
            return self.reason

    methods = lambda s: vision.extraction_methods(s)[1]
    assert methods(Segmenter(None)) == ("segmenter", True, None) and methods(Segmenter("cold")) == ("segmenter", False, "cold")
    assert methods(Segmenter("broken")) == ("segmenter", False, "OSError: no weights") and methods(7)[1] is False and methods(None)[1] is False


def test_scenes_from_items(spark, tmp_path):
    item = lambda k, x: {"id": f"s{k}", "properties": {"datetime": "2024-05-0%dT10:00:00Z" % k, "eo:cloud_cover": 10.0 * k, "platform": "p"}, "assets": {"B04": {"href": f"r{k}"}, "rendered_preview": {"href": "t"}}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 2, 0], [x, 2], [x, 0]]]}}
    (tmp_path / "one.json").write_text(json.dumps(item(1, 0)))
    (tmp_path / "many.json").write_text(json.dumps({"type": "FeatureCollection", "features": [item(2, 0), item(3, 5), item(4, 0)]}))
    scenes = catalog.scenes_from_items(spark, str(tmp_path))
    found = catalog.search_scenes(scenes, F.to_timestamp(F.lit("2024-05-01")), F.to_timestamp(F.lit("2024-05-31")), 35.0, polygon=[(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]).collect()
    assert [r.scene_id for r in found] == ["s1", "s2"] and found[0].thumbnail_url == "t" and found[0].hrefs["B04"] == "r1"
    beyond = catalog.search_scenes(scenes, F.to_timestamp(F.lit("2024-05-01")), F.to_timestamp(F.lit("2024-05-31")), 35.0, polygon=[(1.8, 1.8), (1.9, 1.8), (1.9, 1.9)])
    assert beyond.count() == 0  # in the footprint's box, not in the footprint


def test_lookups(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    wanted = spark.createDataFrame([(2,), (3,)], "id int")
    assert [r.id for r in catalog.existing(wanted, now, ["id"]).collect()] == [2] and catalog.lookup(now, id=2).name == "b" and catalog.lookup(now, id=9) is None
    with pytest.raises(LookupError, match="'id': 3"):
        catalog.require(wanted, now, ["id"])
    assert catalog.require(wanted.where("id = 2"), now, ["id"]).count() == 1


def test_report_with_a_picture():
    picture = np.zeros((3, 5, 4), np.uint8)
    picture[1, 2] = (9, 8, 7, 255)
    page = reports.pdf_page("A (b)", ["mean: 0.500"], reports.png(picture))
    assert reports.pdf_lines(page) == ["A (b)", "mean: 0.500"] and b"/Width 5 /Height 3" in page and b"/SMask 7 0 R" in page and page.count(b"/Im1") == 2
    at = page.index(b"/ColorSpace /DeviceRGB")
    assert zlib.decompress(page[page.index(b"stream\n", at) + 7 : page.index(b"\nendstream", at)])[(5 + 2) * 3 :][:3] == bytes((9, 8, 7))


def test_bare_shapefile():
    import io
    import zipfile

    data = shapefile.write_zip([([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], {"row": "1"})])
    bare = next(zipfile.ZipFile(io.BytesIO(data)).read(n) for n in zipfile.ZipFile(io.BytesIO(data)).namelist() if n.endswith(".shp"))
    (ordinal, parts, attributes, prj), = shapefile.read_zip(bare)
    assert ordinal == 0 and len(parts[0]) == 4 and attributes == {} and prj is None


def test_columns_of_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in BOW])
    r = spark.range(1).select(rings.valid(ring).alias("v"), F.size(rings.repair(ring)).alias("n"), F.size(rings.parts_in_box(ring, F.lit(-1.0), F.lit(-1.0), F.lit(9.0), F.lit(9.0))).alias("p"), rings.valid(F.lit(None).cast(G.RING)).alias("none")).first()
    assert (r.v, r.n, r.none) == (False, 1, False)


def test_grids_that_do_not_fit(spark):
    grid = lambda n, name: spark.range(n * n).select(F.lit(1).alias("g"), F.expr(f"cast(id div {n} as int)").alias("px_row"), F.expr(f"cast(id % {n} as int)").alias("px_col"), F.lit(0.5).alias(name))
    got = catalog.align_bands(grid(6, "nir"), grid(3, "swir1"), 2, "swir1", ["g"], strict=True)
    assert got.where("swir1 = 0.5").count() == 36
    with pytest.raises(ValueError, match="4 x 4, not 3 x 3"):
        catalog.align_bands(grid(6, "nir"), grid(4, "swir1"), 2, "swir1", ["g"], strict=True)
    with pytest.raises(ValueError, match="differ in shape"):
        catalog.require_aligned(grid(6, "nir"), grid(3, "swir1").where("false"), 2, ["g"])


def test_zones_come_in_order(spark):
    px = spark.createDataFrame([(g, z) for g in (2, 1) for z in (2, 0, 1, 1)], "g int, zone int")
    assert [(r.g, r.zone) for r in zones.summary(px, "g", 3).collect()] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
