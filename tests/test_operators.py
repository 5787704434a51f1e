"""Analytic fixtures: answers by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import spectral
from fieldloom.operators import catalog, components, kernels, plots, vision, zonal, zones
from fieldloom.plans import catalogue


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def pixels(spark, rows, group="boundary_id", value="v"):
    return spark.createDataFrame([(1, r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], f"{group} long, px_row int, px_col int, {value} double")


def test_ratio_guards(spark):
    n = F.lit(None).cast("double")
    r = one(spark, zero=spectral.difference_ratio(F.lit(0.0), F.lit(0.0)), sum0=spectral.difference_ratio(F.lit(1.0), F.lit(-1.0)), low=spectral.safe_ratio(F.lit(-9.0), F.lit(1.0)), none=spectral.difference_ratio(n, F.lit(0.1)))
    assert (r.zero, r.sum0, r.low, r.none) == (0.0, 1.0, -1.0, None)


def test_registry_takes_new_indices(spark):
    spectral.register_index("vari", ("red", "green", "blue"), lambda r, g, b: spectral.safe_ratio(g - r, g + r - b))
    try:
        assert one(spark, v=spectral.index_column("vari", {"red": F.lit(0.1), "green": F.lit(0.3), "blue": F.lit(0.1)})).v == pytest.approx(0.2 / 0.3)
        with pytest.raises(ValueError):
            spectral.index_column("none")
        with pytest.raises(ValueError):
            spectral.index_column("ndvi", {"red": F.lit(0.1)})
    finally:
        del spectral.INDICES["vari"]


def test_colours(spark):
    c = lambda v, ramp="RdYlGn": tuple(one(spark, **spectral.colorize(F.lit(v).cast("double"), ramp, 0.0, 1.0)))
    assert c(-5.0) == (215, 48, 39, 255) and c(1.0) == (26, 152, 80, 255) and c(0.5, "unknown") == (255, 255, 191, 255) and c(None) == (0, 0, 0, 0)


def test_sample_boundary_area(spark):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[7.49,9.05],[7.495,9.05],[7.495,9.055],[7.49,9.055],[7.49,9.05]]]}}]}'
    bad = ["{}", "not json", '{"type":"FeatureCollection","features":[]}', '{"type":"Point","coordinates":[1,2]}', None]
    rows = catalog.ingest_boundaries(spark.createDataFrame([(i, t) for i, t in enumerate([text, *bad])], "id int, geojson string")).orderBy("id").collect()
    assert rows[0].area_ha == pytest.approx(111320**2 * math.cos(math.radians(9.0525)) * 0.005**2 / 1e4, abs=0.01) and rows[0].problem is None
    assert all(r.problem and r.area_ha is None for r in rows[1:])


def test_polygons(spark):
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4))
    concave = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    at = lambda x, y, test=G.strictly_inside, r=square: test(F.lit(float(x)), F.lit(float(y)), r)
    r = one(spark, area=G.polygon_area(F.array(square, hole)), c=G.centroid(square), inside=at(5, 5), edge=at(10, 5), corner=at(0, 0), out=at(11, 5), notch=at(2, 3, G.inside, concave), part=G.ring_area(G.clip_to_box(concave, F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(1.0))))
    assert r.area == 96 and (r.c.x, r.c.y) == (5, 5) and (r.inside, r.edge, r.corner, r.out, r.notch) == (True, False, False, False, False) and r.part == pytest.approx(4)


@pytest.mark.parametrize("crs", ["EPSG:32632", "EPSG:32733", "EPSG:3857", "EPSG:4326"])
def test_reference_systems(spark, crs):
    lat = -9.5 if "327" in crs else 9.5
    there = G.from_wgs84(F.lit(9.7), F.lit(lat), crs)
    r = spark.range(1).select(there.alias("p")).select("p", G.to_wgs84(F.col("p.x"), F.col("p.y"), crs).alias("q")).first()
    assert r.q.x == pytest.approx(9.7, abs=1e-8) and r.q.y == pytest.approx(lat, abs=1e-8)


def test_utm_known_point(spark):
    r = one(spark, p=G.from_wgs84(F.lit(9.0), F.lit(0.0), "EPSG:32632")).p
    assert (r.x, r.y) == (pytest.approx(500_000), pytest.approx(0, abs=1e-6))
    with pytest.raises(ValueError):
        G.to_wgs84(F.lit(1.0), F.lit(1.0), "EPSG:2154")


def test_statistics(spark):
    px = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)] + [(2, None)], "boundary_id long, v double")
    a, b = zonal.by_key(px, F.col("v"), "boundary_id").orderBy("boundary_id").collect()
    assert a.std == pytest.approx(1.1180339887) and (a.mean, a.pixel_count) == (2.5, 4)
    assert (b.mean, b.min, b.max, b.std, b.pixel_count) == (None, None, None, None, 0)


def test_plants_on_edges_and_overlaps(spark):
    shapes = spark.range(1).select(F.lit(1).cast("long").alias("boundary_id"), F.explode(F.array(F.struct(F.lit(0).alias("plot_id"), ring((0, 0), (10, 0), (10, 10), (0, 10)).alias("ring")), F.struct(F.lit(1).alias("plot_id"), ring((5, 0), (40, 0), (40, 10), (5, 10)).alias("ring")), F.struct(F.lit(2).alias("plot_id"), ring((90, 0), (91, 0), (91, 1), (90, 1)).alias("ring")))).alias("s")).select("boundary_id", "s.*")
    plants = spark.createDataFrame([(1, 7.0, 5.0, 2.0), (1, 10.0, 5.0, 4.0), (1, 5.0, 5.0, 9.0), (1, 30.0, 5.0, 1.0), (1, None, 5.0, 1.0)], "boundary_id long, x double, y double, canopy_area_m2 double")
    got = {r.plot_id: (r.plant_count, r.mean_canopy_area_m2) for r in zonal.plants_per_plot(plants, shapes).collect()}
    assert got == {0: (2, 5.5), 1: (3, 2.3333), 2: (0, None)}


def test_grid(spark):
    e = plots.grid_estimate(F.lit(1.0), F.lit(1.0), F.lit(40))
    assert tuple(one(spark, **e)) == (6, 7)
    b = spark.range(1).select(F.lit(1).alias("boundary_id"), ring((0, 0), (0.004, 0), (0, 0.004)).alias("ring"))
    cells = plots.grid_plots(b, 4, 4).orderBy("plot_id").collect()
    assert [c.plot_id for c in cells] == list(range(10)) and cells[0].row_idx == 0 and cells[-1].row_idx == 3
    whole = spark.range(1).select(G.metric_area(G.ring_area(ring((0, 0), (0.004, 0), (0, 0.004))), F.lit(0.004 / 3)).alias("a")).first().a
    assert sum(c.area_m2 for c in cells) == pytest.approx(whole, abs=1)
    assert plots.grid_plots(b, 0, 4).count() == 0


def test_row_chaining(spark):
    rows = [(1, i, i * 1e-3, 0.01 + i * 2e-6, 100.0, 10) for i in range(4)] + [(1, 9, 0.0, 0.0, 100.0, 10)]
    got = plots.grid_positions(spark.createDataFrame(rows, "g int, cand_id int, x double, y double, area_m2 double, area_px int"), ["g"]).orderBy("plot_id").collect()
    assert [(r.cand_id, r.row_idx, r.col_idx) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (9, 1, 0)]


def test_zones(spark):
    px = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1.1, 5, 5.2, 9, 9.1])] + [(1, 9, None), (2, 0, 1.0)], "boundary_id long, i int, v double")
    got = {(r.boundary_id, r.i): r.zone for r in zones.classify(px, "v", "boundary_id", 3).collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 1, 1, 2, 2] and got[1, 9] is None and got[2, 0] is None
    assert one(spark, a=zones.rate_of(F.lit(3), 4), b=zones.rate_of(F.lit(4), 5)) == ("Zone 3", "Very low")


def test_regions(spark):
    art = ["##..#", ".#.##", "#....", ".####"]
    mask = spark.createDataFrame([(1, r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"], "boundary_id long, px_row int, px_col int")
    four = components.label_regions(mask).select("region").distinct().count()
    assert four == 4 and components.label_regions(mask, diagonal=True).select("region").distinct().count() == 2


def test_markers_of_whole_rasters(spark):
    sf = "/root/testdata/sf0.01"
    on = {tuple(r) for r in catalogue.vegetation_mask(spark, sf).where("v = 1").select("boundary_id", "px_row", "px_col").collect()}
    want = {}
    for start in sorted(on):  # the first pixel met of a region is its least
        todo = [start]
        while todo:
            g, r, c = at = todo.pop()
            if at in on and at not in want:
                want[at] = start[1] * 1000 + start[2]
                todo += [(g, r + 1, c), (g, r - 1, c), (g, r, c + 1), (g, r, c - 1)]
    assert max(r for _, r, _ in on) == 49
    got = catalogue.QUERIES["markers"](spark, sf).collect()
    assert len(got) == len(on) and {tuple(r)[:3]: r.region for r in got} == want


def test_opening_and_otsu(spark):
    art = [[1.0] * 5 + [0.0, 1.0] for _ in range(5)]
    opened = vision.morph_open(pixels(spark, art), "v", 3).where("v = 1")
    assert opened.count() == 25
    flat = spark.createDataFrame([(1, 7)] * 4, "raster_id int, level int")
    assert vision.otsu(flat, "level").first().threshold == 7
    two = spark.createDataFrame([(1, v) for v in (10, 11, 12, 200, 201)], "raster_id int, level int")
    assert vision.otsu(two, "level").first().threshold == 12


def test_constant_image_has_no_plant(spark):
    rgb = spark.createDataFrame([(1, r, c, 9, 9, 9) for r in range(4) for c in range(4)], "raster_id long, px_row int, px_col int, r int, g int, b int")
    assert vision.exg_mask(rgb).where("plant").count() == 0
    assert vision.plant_summary(rgb).first().plant_count == 0


def test_distance_by_brute_force():
    mask = np.random.default_rng(3).random((17, 23)) < 0.8
    zeros = np.argwhere(~mask)
    want = [[min(((zeros - (y, x)) ** 2).sum(1)) for x in range(23)] for y in range(17)]
    assert np.array_equal(kernels.squared_distance(mask), want)


def test_watershed_splits_discs():
    y, x = np.mgrid[:40, :50]
    disc = lambda a, b, r: (y - a) ** 2 + (x - b) ** 2 <= r * r
    labels = kernels.watershed_labels(disc(15, 15, 6) | disc(15, 26, 6), 8)
    assert labels.max() == 2 and abs((labels == 1).sum() - (labels == 2).sum()) <= 8


def test_contours():
    block = np.ones((6, 10), bool)
    path = np.array(kernels.outer_contour(block), float)
    assert kernels.shoelace(path) == 45 and kernels.least_rectangle(path) == 45
    holed = np.ones((7, 7), bool)
    holed[3, 3] = False
    assert kernels.shoelace(np.array(kernels.outer_contour(holed), float)) == 36
    rings = kernels.boundary_rings(holed)
    assert sorted(len(r) for r in rings) == [4, 4]
    assert len(kernels.simplify_ring(path, 0.5)) == 4
    assert kernels.outer_contour(np.ones((1, 1), bool)) == [(0, 0)]


def test_plant_queries_read_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    masks = {}
    for g, r, c in catalogue.exg_mask(spark, sf).where("plant").select("raster_id", "px_row", "px_col").collect():
        masks.setdefault(g + 100, np.zeros((50, 50), bool))[r, c] = True
    want = {(g, r, c): labels[r, c] for g, m in masks.items() for labels in [kernels.watershed_labels(m, 8)] for r, c in np.argwhere(labels)}
    flooded = catalogue.watershed(spark, sf).collect()
    got = {(r.raster_id, r.px_row, r.px_col): r.plant_id for r in flooded}
    assert len(flooded) == len(got) and {k: v for k, v in got.items() if k[0] >= 100} == want and want
    assert len({v for k, v in got.items() if k[0] == 1}) == 3
    sizes = {}
    for (g, _, _), p in got.items():
        sizes[g, p] = sizes.get((g, p), 0) + 1
    blobs = {(r.raster_id, r.plant_id): r.area_px for r in catalogue.plant_blobs(spark, sf).collect()}
    assert blobs == {k: n for k, n in sizes.items() if n >= 15} and {g for g, _ in blobs} > {1}
    points = catalogue.plant_points(spark, sf).groupBy("raster_id").count().collect()
    counts = {r.raster_id: r.plant_count for r in catalogue.plant_count(spark, sf).collect()}
    assert {r.raster_id: r["count"] for r in points} == {g: n for g, n in counts.items() if n} and counts[1] == 3


def test_synthetic_bands_have_the_default_resolution(spark):
    sides = catalogue.synthetic_bands(spark, "/root/testdata/sf0.001").groupBy("boundary_id").agg(F.count(F.lit(1)), F.max("px_row"), F.max("px_col")).collect()
    assert len(sides) == 25 and all(tuple(r)[1:] == (128 * 128, 127, 127) for r in sides)


def test_segments_of_all_events(spark):
    sf = "/root/testdata/sf0.01"
    sizes, edges = {}, {}
    for e, u in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id").collect():
        key = e // 2500, 6 if u % 6 == 0 and e % 50 == 0 else u % 6
        sizes[key] = sizes.get(key, 0) + 1
        edges[key] = edges.get(key, 0) + (e % 2500 // 50 in (0, 49)) + (e % 50 in (0, 49))
    want = {k: (round(n / 2500, 9), round(edges[k] / 200, 9)) for k, n in sizes.items() if 0.004 <= n / 2500 <= 0.3 and edges[k] / 200 <= 0.5}
    got = catalogue.QUERIES["segment_filter"](spark, sf).collect()
    assert {(r.raster_id, r.segment): (r.area_frac, r.border_frac) for r in got} == want and any(k[1] == 0 for k in want)


def test_change_log(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, "c", 2, True)], "k int, v string, version int, deleted boolean")
    now = catalog.current(log, ["k"])
    assert [tuple(r) for r in now.collect()] == [(1, "b")]
    emptied = log.unionByName(catalog.replaced(now, now.where("false"), "k", 3))
    assert catalog.current(emptied, ["k"]).count() == 0
