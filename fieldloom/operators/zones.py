"""Management zones: one-dimensional k-means on a value, by its optimum or by Lloyd's rounds; labels in the order of the values, application rates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.storage import by_size, written
from . import kernels

#: Suggested rates of three and of five zones, from the lowest value to the highest.
RATES = {
    3: ("High (low vigor -> more input)", "Standard", "Low (already vigorous)"),
    5: ("Very high", "High", "Standard", "Low", "Very low"),
}


def rate_of(zone: Column, n_zones: int) -> Column:
    if n_zones not in RATES:
        return F.concat(F.lit("Zone "), zone.cast("string"))
    return F.element_at(F.array(*[F.lit(r) for r in RATES[n_zones]]), zone + 1)


#: Distinct values of a group up to which each is a cell of its own, and the cells of equal width that larger groups get.
CELLS = 1 << 20


def _values(pixels: DataFrame, value: str, group: str, n_zones: int, few: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values of each group with their numbers, and a row for each group."""
    counted = pixels.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    seen = written(counted, "zone-values")
    span = seen.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_distinct"), F.sum("_n").alias("_all"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    span = written(span, "zone-spans")  # a row for each group
    if few == "raise":
        short = span.where(F.col("_all") < n_zones).limit(1).collect()
        if short:
            raise ValueError(f"{short[0]['_g']} has {short[0]['_all']} values for {n_zones} zones")
    return seen, span


def classify(pixels: DataFrame, value: str, group: str, n_zones: int = 3, few: str = "null", cells: int = CELLS) -> DataFrame:
    """``pixels`` with ``zone``: 0 is the zone of the lowest values, NULL where the value is.

    One-dimensional k-means at its global optimum: of all ways to cut a group's sorted values into ``n_zones`` stretches the one with the
    least squared distance to the stretches' means (the lowest cuts, if several), so no start is drawn and no round made. The
    distinct values of a group are counted by all tasks, and one task cuts at most ``cells`` of them; a group with more is first
    dealt into that many cells of equal width, each with its number, sum and sum of squares, and cut between cells. Values are
    then compared with the cuts. Groups of fewer values than zones get no zone, or raise with ``few="raise"``; with
    fewer distinct values than zones each is a zone, from 0 on.
    """
    seen, span = _values(pixels, value, group, n_zones, few)
    enough = span.where(F.col("_all") >= n_zones)
    width = (F.col("_high") - F.col("_low")) / F.lit(float(cells))
    cell = F.when(F.col("_distinct") > cells, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(cells - 1)).cast("double")).otherwise(F.col("_v"))
    own = F.col("_v") - F.col("_mean")  # sums of squares keep their digits
    moments = seen.join(by_size(enough), "_g").groupBy("_g", cell.alias("_cell")).agg(F.sum("_n").alias("n"), F.sum(own * F.col("_n")).alias("s"), F.sum(own * own * F.col("_n")).alias("q"), F.max("_v").alias("top"))
    kind = seen.schema["_g"].dataType.simpleString()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cell")
        ends = kernels.best_cuts(*(pdf[c].to_numpy(float) for c in ("n", "s", "q")), n_zones)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_cuts": [pdf["top"].to_numpy()[ends].tolist()]})

    cuts = written(moments.groupBy("_g").applyInPandas(cut, f"_g {kind}, _cuts array<double>"), "zone-cuts")
    labelled = pixels.join(by_size(cuts.withColumnRenamed("_g", group)), group, "left")
    zone = F.aggregate("_cuts", F.lit(0), lambda z, c: z + (F.col(value) > c).cast("int"))
    return labelled.withColumn("zone", F.when(F.col(value).isNotNull() & F.col("_cuts").isNotNull(), zone)).drop("_cuts")


def nearest(value: Column, centres: Column, n: int) -> Column:
    """The number of the centre nearest to a value, the lower one of two as near."""
    away = F.array(*[F.abs(value - centres[k]) for k in range(n)])
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def settle(pixels: DataFrame, value: str, group: str, n_zones: int = 3, few: str = "null", cells: int = CELLS) -> DataFrame:
    """``pixels`` with ``zone``: 0 is the zone of the lowest centre, NULL where the value is.

    Lloyd's rounds until none moves a centre, from two starts: centres spread evenly over the range, and by the standard deviation round the
    mean. The start with the least squared distance counts, the even one of equals; centres are rounded to 12 digits, squared
    distances to 9; ties go to the lower centre, and one without values stays. Groups of up to ``cells`` distinct values settle in
    one task each, larger ones in rounds of all tasks. Groups of fewer values than zones get no zone, or raise with ``few="raise"``.
    """
    seen, span = _values(pixels, value, group, n_zones, few)
    kind = seen.schema["_g"].dataType.simpleString()

    def centres_of(pdf: pd.DataFrame) -> pd.DataFrame:
        centres = kernels.settled_centres(pdf["_v"].to_numpy(), pdf["_n"].to_numpy(), n_zones)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_centres": [centres.tolist()]})

    enough = span.where(F.col("_all") >= n_zones)
    small = by_size(enough.where(F.col("_distinct") <= cells).select("_g"))
    centres = seen.join(small, "_g", "left_semi").groupBy("_g").applyInPandas(centres_of, f"_g {kind}, _centres array<double>")
    large = enough.where(F.col("_distinct") > cells)
    if not large.isEmpty():
        centres = centres.unionByName(_in_rounds(seen, large, n_zones))
    centres = written(centres, "zone-centres").withColumnRenamed("_g", group)
    labelled = pixels.join(by_size(centres), group, "left")
    known = F.col(value).isNotNull() & F.col("_centres").isNotNull()
    return labelled.withColumn("zone", F.when(known, nearest(F.col(value), F.col("_centres"), n_zones))).drop("_centres")


def _in_rounds(seen: DataFrame, large: DataFrame, n_zones: int) -> DataFrame:
    """The centres (_g, _centres) of groups (a row each) whose values are too many for one task: a job a round, for all groups that still move."""
    seen = seen.join(by_size(large.select("_g", "_low", "_high", "_mean")), "_g")
    std = F.sqrt(F.sum(F.pow(F.col("_v") - F.col("_mean"), 2) * F.col("_n")) / F.sum("_n")).alias("_std")
    place = lambda k: (2 * k + 1) / (2 * n_zones)
    even = F.array(*[F.round(F.col("_low") + (F.col("_high") - F.col("_low")) * place(k), 12) for k in range(n_zones)])
    spread = F.array(*[F.round(F.col("_mean") + F.col("_std") * (3 * place(k) - 1.5), 12) for k in range(n_zones)])
    starts = F.posexplode(F.array(even, spread)).alias("_start", "_centres")
    moving = written(seen.groupBy("_g", "_low", "_high", "_mean").agg(std).select("_g", starts), "zone-rounds")
    seen, done = seen.select("_g", "_v", "_n"), []
    zone = nearest(F.col("_v"), F.col("_centres"), n_zones)
    while not moving.isEmpty():
        of = lambda k, x: F.sum(F.when(F.col("_zone") == k, x))
        means = F.array(*[F.round(F.coalesce(of(k, F.col("_v") * F.col("_n")) / of(k, F.col("_n")), F.col("_centres")[k]), 12) for k in range(n_zones)])
        after = seen.join(by_size(moving), "_g").withColumn("_zone", zone).groupBy("_g", "_start", "_centres").agg(means.alias("_after"))
        after = written(after, "zone-rounds")
        done.append(after.where("_after = _centres").drop("_after"))
        moving = after.where("_after != _centres").select("_g", "_start", F.col("_after").alias("_centres"))
    settled = reduce(DataFrame.unionByName, done)
    away = F.sum(F.pow(F.col("_v") - F.get("_centres", zone), 2) * F.col("_n"))
    cost = seen.join(by_size(settled), "_g").groupBy("_g", "_start", "_centres").agg(F.round(away, 9).alias("_cost"))
    return cost.groupBy("_g").agg(F.min_by("_centres", F.struct("_cost", "_start")).alias("_centres"))


def summary(zoned: DataFrame, group: str, n_zones: int, region: str | None = None) -> DataFrame:
    """pixel_count, region_count (if a region column is given) and suggested rate of each zone, in order."""
    counts = [F.count(F.lit(1)).alias("pixel_count")] + ([F.countDistinct(region).alias("region_count")] if region else [])
    return zoned.where("zone IS NOT NULL").groupBy(group, "zone").agg(*counts).withColumn("suggested_rate", rate_of(F.col("zone"), n_zones)).orderBy(group, "zone")
