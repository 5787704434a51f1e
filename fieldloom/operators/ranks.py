"""Exact order statistics by counting: no value list and no buffer of a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.storage import maybe_broadcast, written


def quantiles(df: DataFrame, value: str | Column, group: str, shares: list[float]) -> DataFrame:
    """(group, _p): the interpolated quantiles of each group's values, NULL and NaN left out; a group without values has no row.

    Distinct values are counted, dealt by range of (group, value) and written; the parts' sums give each part the rank it
    starts at, so a wanted rank names its part, and only those parts are looked through for their values.
    """
    v = F.col(value) if isinstance(value, str) else value
    known = df.select(F.col(group).alias("_g"), v.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    counts = known.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "ranks-counts")
    sums = dealt.groupBy("_g", "_part").agg(F.sum("_n").alias("_n"))  # a row for each group and part that hold one another
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_g", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(W.partitionBy("_g")).alias("_all"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("_all") - 1)).alias("at")) for k, s in enumerate(shares)])
    places = sums.withColumn("_at", F.explode(at)).select("*", F.explode(F.array(F.floor("_at.at"), F.ceil("_at.at"))).alias("_rank"))
    wanted = written(places.where("_rank >= _from AND _rank < _from + _n").select("_g", "_part", "_from", "_rank", "_at.k", "_at.at").distinct(), "ranks-wanted")
    parts = dealt.join(maybe_broadcast(wanted.select("_g", "_part", "_from").distinct()), ["_g", "_part"])
    upto = W.partitionBy("_g", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = parts.withColumn("_to", F.col("_from") + F.sum("_n").over(upto)).drop("_from")
    met = ranked.join(maybe_broadcast(wanted.drop("_from")), ["_g", "_part"]).where("_rank < _to AND _rank >= _to - _n")
    ends = met.groupBy("_g", "k").agg(F.max("at").alias("at"), F.min(F.struct("_rank", "_v")).alias("low"), F.max(F.struct("_rank", "_v")).alias("high"))
    low, high = F.col("low"), F.col("high")
    between = (high["_rank"] - F.col("at")) * low["_v"] + (F.col("at") - low["_rank"]) * high["_v"]
    value_at = F.when((low["_rank"] == high["_rank"]) | (low["_v"] == high["_v"]), low["_v"]).otherwise(between)
    one = ends.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("k", value_at.alias("v")))).alias("_p"))  # as many as there are shares
    return one.select(F.col("_g").alias(group), F.transform("_p", lambda s: s["v"]).alias("_p"))
