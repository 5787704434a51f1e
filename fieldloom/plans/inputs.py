"""Test inputs derived from the generated tables, in Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: band: (offset, first factor, second factor, modulus); value = (offset + mix % modulus) / 1000
BANDS = {
    "blue": (10, 7901, 104717, 191), "green": (20, 7907, 104723, 281), "red": (20, 7919, 104729, 381),
    "rededge": (50, 7883, 104711, 551), "nir": (50, 6101, 15485863, 651), "swir1": (50, 7879, 104707, 451),
}

PIXELS_SQL = "pixels AS (SELECT (event_id // 2500)::bigint AS boundary_id, ((event_id % 2500) // 50)::int AS px_row, (event_id % 50)::int AS px_col, " + ", ".join(f"CASE WHEN event_type = 'error' THEN NULL ELSE ({o} + (event_id * {a} + user_id * {b}) % {m}) / 1000e0 END AS {n}" for n, (o, a, b, m) in BANDS.items()) + " FROM events)"
RGB_SQL = "rgb AS (SELECT (event_id // 2500)::bigint AS raster_id, ((event_id % 2500) // 50)::int AS px_row, (event_id % 50)::int AS px_col, ((event_id * 37 + user_id * 101) % 256)::int AS r, ((event_id * 53 + user_id * 151) % 256)::int AS g, ((event_id * 71 + user_id * 211) % 256)::int AS b FROM events)"
BOXES_SQL = "boxes AS (SELECT n_nationkey::bigint AS boundary_id, n_name AS name, n_nationkey % 7 * 0.5e0 + 7e0 AS minx, n_nationkey % 11 * 0.4e0 - 2e0 AS miny, n_nationkey % 7 * 0.5e0 + 7e0 + 0.004e0 + n_nationkey % 5 * 0.001e0 AS maxx, n_nationkey % 11 * 0.4e0 - 2e0 + 0.003e0 + n_nationkey % 3 * 0.002e0 AS maxy FROM nation)"
PLOTS_SQL = "plots AS (SELECT c_custkey AS plot_key, c_nationkey::bigint AS boundary_id, (c_custkey % 97)::int AS plot_id, (c_custkey % 97 // 10)::int AS row_idx, (c_custkey % 97 % 10)::int AS col_idx, c_acctbal AS area_m2 FROM customer)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all tasks: few rows that make many would else be exploded by the one task that reads them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _place(df: DataFrame, group: str, *values) -> DataFrame:
    return df.select(F.expr("event_id div 2500").alias(group), F.expr("cast(event_id % 2500 div 50 as int)").alias("px_row"), F.expr("cast(event_id % 50 as int)").alias("px_col"), *values)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 50 x 50 raster per 2,500 events; errors are missing pixels."""
    ok = F.col("event_type") != "error"
    band = lambda n: F.when(ok, (F.lit(BANDS[n][0]) + (F.col("event_id") * BANDS[n][1] + F.col("user_id") * BANDS[n][2]) % BANDS[n][3]) / F.lit(1000.0)).alias(n)
    return _place(table(spark, sf_dir, "events"), "boundary_id", *[band(n) for n in BANDS])


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda a, b, n: ((F.col("event_id") * a + F.col("user_id") * b) % 256).cast("int").alias(n)
    return _place(table(spark, sf_dir, "events"), "raster_id", level(37, 101, "r"), level(53, 151, "g"), level(71, 211, "b"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes in degrees, one per nation."""
    k = F.col("n_nationkey")
    x, y = k % 7 * F.lit(0.5) + 7.0, k % 11 * F.lit(0.4) - 2.0
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("boundary_id"), F.col("n_name").alias("name"), x.alias("minx"), y.alias("miny"), (x + 0.004 + k % 5 * F.lit(0.001)).alias("maxx"), (y + 0.003 + k % 3 * F.lit(0.002)).alias("maxy"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("plot_key"), F.col("c_nationkey").cast("long").alias("boundary_id"), (k % 97).cast("int").alias("plot_id"), F.expr("cast(c_custkey % 97 div 10 as int)").alias("row_idx"), (k % 97 % 10).cast("int").alias("col_idx"), F.col("c_acctbal").alias("area_m2"))


def diamonds(pix: DataFrame) -> DataFrame:
    """Four overlapping diamonds and one far outside, per raster, in pixel coordinates."""
    rings = ((0, 15.0, 15.0, 14.0), (1, 33.0, 17.0, 16.0), (2, 20.0, 36.0, 12.5), (3, 38.0, 38.0, 11.0), (4, 500.0, 500.0, 5.0))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    shapes = F.array(*[F.struct(F.lit(i).alias("plot_id"), F.array(point(x, y - r), point(x + r, y), point(x, y + r), point(x - r, y)).alias("ring")) for i, x, y, r in rings])
    return pix.select("boundary_id").distinct().select("boundary_id", F.explode(shapes).alias("s")).select("boundary_id", "s.*")


DIAMONDS_SQL = "shapes(plot_id, cx, cy, rad) AS (VALUES (0, 15e0, 15e0, 14e0), (1, 33e0, 17e0, 16e0), (2, 20e0, 36e0, 12.5e0), (3, 38e0, 38e0, 11e0), (4, 500e0, 500e0, 5e0))"
