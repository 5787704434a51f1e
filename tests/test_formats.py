import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.sources import reports, shapefile, synthetic, tiff


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 70_000])
def test_lzw(n):
    rng = random.Random(n)
    data = bytes(rng.choice(b"abcab") if rng.random() < 0.8 else rng.randrange(256) for _ in range(n))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_tiff():
    a = np.random.default_rng(1).random((37, 61)).astype(np.float32)
    a[3, 4] = np.nan
    data = tiff.write_band(a, 7.0, 9.5, 0.01, 0.02, 4326)
    assert np.array_equal(tiff.read_bands(data)[0], a, equal_nan=True)
    d = tiff.describe(data)
    assert (d["width"], d["height"], d["crs"], d["dtype"], d["nodata"]) == (61, 37, "EPSG:4326", "float32", "nan") and d["miny"] == pytest.approx(9.5 - 0.74)
    with pytest.raises(ValueError):
        tiff.describe(b"nothing")


def test_shapefile():
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    hole = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4)]
    back = shapefile.read_zip(shapefile.write_zip([([square, hole], {"Row": "2", "name": "é"}), ([square], {"Row": "", "name": "x"})], "plots"))
    assert [len(f[1]) for f in back] == [2, 1] and back[0][2] == {"Row": "2", "name": "é"} and set(back[0][1][0]) == set(square) and "WGS" in back[0][3]
    assert shapefile.read_zip(shapefile.write_zip([])) == []


def test_import_of_rows_and_columns(spark):
    files = spark.createDataFrame([(1, shapefile.write_zip([([[(0.0, 0.0), (0.001, 0.0), (0.001, 0.001)]], {"Plot_Row": "4", "COLUMN": "5"}), ([[(0.0, 0.0), (0.001, 0.0), (0.001, 0.001)]], {"x": "1"})]))], "id int, data binary")
    got = shapefile.imported_plots(shapefile.read_shapefiles(files, "id"), "id").orderBy("plot_id").collect()
    assert [(r.row_idx, r.col_idx) for r in got] == [(4, 5), (0, 1)]


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates> 1,2,0 3,2,0\n3,4,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>b</name></Placemark></Document></kml>")
    rows = shapefile.read_kml(spark, str(tmp_path / "a.kml")).collect()
    assert len(rows) == 1 and [(p.x, p.y) for p in rows[0].ring] == [(1, 2), (3, 2), (3, 4)]


def test_reports():
    image = reports.png(np.full((3, 2, 4), 7, np.uint8))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])[1:5] == b"\7\7\7\7"
    assert reports.scale_colour(1.0, 0.0, 1.0) == "1A9850" and reports.scale_colour(0.0, 0.0, 1.0) == "D73027" and reports.scale_colour(1.0, 1.0, 1.0) is None
    sheet = lambda data: zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert "No data available" in sheet(reports.xlsx([], "t")) and "<v>0.5</v>" in sheet(reports.xlsx([{"plot_id": 1, "mean": 0.5}], "x" * 50))
    page = reports.pdf_page("Field (1)", ["mean: 0.500"])
    assert page.startswith(b"%PDF") and rb"Field \(1\)" in page


def test_synthetic_bands(spark):
    square = spark.range(1).select(F.lit(1).alias("boundary_id"), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))]).alias("ring"))
    px = synthetic.synthetic_bands(square, 32)
    got = px.agg(F.count("*").alias("n"), F.count("red").alias("valid"), F.min("nir").alias("low"), F.max("nir").alias("high")).first()
    assert got.n == 1024 and 450 < got.valid < 580 and got.low >= 0.05 and got.high <= 0.7
    assert px.orderBy("px_row", "px_col").collect() == synthetic.synthetic_bands(square, 32).orderBy("px_row", "px_col").collect()
