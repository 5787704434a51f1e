"""Connected components of an edge table, and of the pixels of a mask."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.storage import by_size, maybe_broadcast, shuffled, written


#: Rounds that one job makes.
AT_ONCE = 1
#: Columns of a stretch by which runs of neighbouring rows meet.
STRETCH = 64
#: Rows of a band whose runs one task joins up.
BAND = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), any ordered type: component is the smallest node reachable.

    Rounds of least neighbour label and pointer jumping, AT_ONCE of them in one job whose result is written, so lineage
    stays short. A hub's edges are joined, never gathered: its least label is pre-aggregated before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "cc-labels")
    sent = F.broadcast if maybe_broadcast(both) is not both else shuffled  # there are no more labels than edges
    while True:
        after = labels.withColumn("was", F.col("component"))
        for _ in range(AT_ONCE):
            near = both.join(sent(after.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
            best = after.join(sent(near), "node", "left").select("node", "was", F.least("component", "near").alias("component"))
            root = after.select(F.col("node").alias("component"), F.col("component").alias("root"))
            after = best.join(sent(root), "component", "left").select("node", "was", F.least("component", "root").alias("component"))
        after = written(after, "cc-labels")
        labels = after.select("node", "component")
        if after.where("was != component").isEmpty():
            return labels


def runs(mask: DataFrame, group: str, value: str | None = None) -> DataFrame:
    """Runs of adjacent mask pixels (of equal ``value``) in a row: group, px_row, c0, c1, value, run (its id)."""
    row = W.partitionBy(group, "px_row").orderBy("px_col")
    v = F.col(value) if value else F.lit(0)
    starts = mask.select(group, "px_row", "px_col", v.alias("value")).withColumn("_new", F.when((F.lag("px_col").over(row) == F.col("px_col") - 1) & (F.lag("value").over(row) == F.col("value")), 0).otherwise(1))
    numbered = starts.withColumn("_run", F.sum("_new").over(row))
    found = numbered.groupBy(group, "px_row", "_run", "value").agg(F.min("px_col").alias("c0"), F.max("px_col").alias("c1")).drop("_run")
    return found.withColumn("run", F.struct(group, "px_row", "c0"))


def local_roots(rows: np.ndarray, c0: np.ndarray, c1: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """For runs sorted by row and column, the first run of each one's connected region among them."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    starts = np.append(np.flatnonzero(np.diff(rows, prepend=-2)), len(rows)).tolist()
    row_at, low, high, kind = rows.tolist(), c0.tolist(), c1.tolist(), value.tolist()
    for one, two, end in zip(starts, starts[1:], starts[2:]):
        if row_at[two] != row_at[one] + 1:
            continue
        j = two
        for i in range(one, two):
            while j < end and high[j] + reach < low[i]:
                j += 1
            k = j
            while k < end and low[k] <= high[i] + reach:
                if kind[i] == kind[k]:
                    x, y = find(i), find(k)
                    root[max(x, y)] = min(x, y)
                k += 1
    return np.array([find(i) for i in range(len(root))], np.int64)


def _banded(reach: int):
    """The root (px_row, c0) of each run of a band of rows, in the order of the runs."""

    @F.arrow_udf(T.ArrayType(T.StructType().add("px_row", "integer").add("c0", "integer")))
    def roots(bands: pa.Array) -> pa.Array:
        size = np.diff(bands.offsets.to_numpy())
        flat = bands.flatten()
        rows, c0, c1 = (flat.field(n).to_numpy() for n in ("px_row", "c0", "c1"))
        value = flat.field("value").dictionary_encode().indices.fill_null(-1).to_numpy()
        at = np.empty(len(rows), np.int64)
        for end, n in zip(np.cumsum(size), size):
            at[end - n : end] = local_roots(rows[end - n : end], c0[end - n : end], c1[end - n : end], value[end - n : end], reach) + (end - n)
        found = pa.StructArray.from_arrays([pa.array(rows[at], pa.int32()), pa.array(c0[at], pa.int32())], ["px_row", "c0"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), found)

    return roots


def label_runs(mask: DataFrame, group: str = "boundary_id", value: str | None = None, diagonal: bool = False) -> DataFrame:
    """Runs (group, value, px_row, c0, c1) of ``mask`` with ``region``: the least pixel (row, col) of their connected region, 4- or 8-connected.

    Runs, not pixels, are the nodes. Bands of BAND rows are joined up first, each in one task, so only what crosses from band to band
    is left for the rounds of ``components``: their number follows the bands that a region winds through, not its length in pixels.
    The runs at the bands' edges are joined by stretch of columns where they overlap. The mask is computed once.
    """
    reach = 1 if diagonal else 0
    found = runs(mask, group, value).withColumn("_band", F.floor(F.col("px_row") / BAND).cast("int"))
    bands = found.groupBy(group, "_band").agg(F.array_sort(F.collect_list(F.struct("px_row", "c0", "c1", "value"))).alias("_runs"))
    both = F.explode(F.arrays_zip(F.col("_runs"), _banded(reach)(F.col("_runs")).alias("_roots"))).alias("z")
    rooted = bands.select(group, both).select(group, "z._runs.*", F.struct(group, "z._roots.px_row", "z._roots.c0").alias("root"))
    table = written(rooted, "cc-runs")
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / STRETCH).cast("int"), F.floor(high / STRETCH).cast("int")))
    last, first = table.where(F.pmod("px_row", F.lit(BAND)) == BAND - 1), table.where(F.pmod("px_row", F.lit(BAND)) == 0)
    up = last.select(F.col("root").alias("a"), group, "value", "px_row", F.col("c0").alias("u0"), F.col("c1").alias("u1")).withColumn("_s", stretch(F.col("u0") - reach, F.col("u1") + reach))
    down = first.select(F.col("root").alias("b"), group, "value", (F.col("px_row") - 1).alias("px_row"), F.col("c0").alias("d0"), F.col("c1").alias("d1")).withColumn("_s", stretch(F.col("d0"), F.col("d1")))
    edges = up.join(shuffled(down), [group, "value", "px_row", "_s"]).where((F.col("u0") <= F.col("d1") + reach) & (F.col("d0") <= F.col("u1") + reach)).select("a", "b").distinct()
    edges = written(edges, "cc-crossing")
    named = table.withColumn("_least", F.col("root"))
    if not edges.isEmpty():
        labels = by_size(components(edges).withColumnRenamed("node", "root"))
        named = table.join(labels, "root", "left").withColumn("_least", F.coalesce("component", "root"))
    return named.select(group, "value", "px_row", "c0", "c1", F.struct(F.col("_least.px_row").alias("row"), F.col("_least.c0").alias("col")).alias("region"))


def label_regions(mask: DataFrame, group: str = "boundary_id", value: str | None = None, diagonal: bool = False) -> DataFrame:
    """``mask`` pixels with ``region``: the least pixel (row, col) of their connected region, 4- or 8-connected.

    Pixels come out of the runs; only further columns of ``mask`` need a join with it.
    """
    named = label_runs(mask, group, value, diagonal)
    place = [group, "px_row", "px_col"]
    pixels = named.select(group, "px_row", F.explode(F.sequence("c0", "c1")).alias("px_col"), F.col("value").alias(value or "_value"), "region")
    if set(mask.columns) <= {*place, value}:
        return pixels.select(*mask.columns, "region")
    return mask.join(shuffled(pixels.select(*place, "region")), place)
