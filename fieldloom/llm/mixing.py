"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by a seeded hash) and may pass up to ``repeats`` times. A
pass of a document has the virtual finish time (words of its source up to and with it) / (weight of its source).
All passes are range-sorted by that time and the sorted list is cut at the total budget, the sum of all sizes.
A source that has given all its passes drops out and the others share what is left by weight, so the words that
each source gives come near the targets, which are found by the same water-filling in closed form.

Running sums are made over range partitions: sort by range, sum within each partition, add the partitions'
offsets (one row for each partition and source). No task ever holds a whole source.

The shuffled order is by a seeded hash of identifier and text, then by the row's place in its file, so reruns over
the same files agree, and rows without an identifier are spread by their texts.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last; a
null identifier is mixed like any other; rows of equal identifier and text may stand for one another, others of equal
identifier are told apart by their texts; repeated rows are separate passes; an empty table gives an empty mix; other
columns are ignored, or with ``mixed`` passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.storage import cleared

from .common import Rows, located, maybe_broadcast, word_count, written

SEED, REPEATS, WEIGHTS = "mix-1", 3, (1, 2, 3)


def running_sum(df: DataFrame, key: str | None, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``running`` and ``position``: sum of ``value`` and number of rows up to each row, within ``key``.

    Rows are sorted by ``key`` and ``order`` over all partitions. Equal rows get successive sums.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ([key] if key else []) + order
    schema = T.StructType(df.schema.fields).add("part", "integer").add("running", "long").add("position", "long")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, total, count = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not len(b):
                continue
            keys = b[key] if key else pd.Series(0, b.index)
            sums, counts = b.groupby(keys, sort=False)[value].cumsum(), b.groupby(keys, sort=False).cumcount() + 1
            same = keys == last
            b["part"], b["running"], b["position"] = part, sums + same * total, counts + same * count
            last, total, count = keys.iloc[-1], int(b["running"].iloc[-1]), int(b["position"].iloc[-1])
            yield b

    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    local = written(ranged.mapInPandas(scan, schema), name)
    keys = [key] if key else []
    ends = local.groupBy("part", *keys).agg(F.max("running").alias("sum"), F.max("position").alias("rows"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = ends.select("part", *keys, F.coalesce(F.sum("sum").over(before), zero).alias("sum_before"), F.coalesce(F.sum("rows").over(before), zero).alias("rows_before"))
    joined = local.join(maybe_broadcast(offsets), ["part", *keys])
    return joined.withColumns({"running": F.col("running") + F.col("sum_before"), "position": F.col("position") + F.col("rows_before")}).drop("part", "sum_before", "rows_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: rank, weight, source_size, budget and target.

    Sources are numbered over range partitions. The level that fills the budget is found in rounds: a source above
    its top is held there and the others share the rest, until no more are; each round is one aggregation.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    each = running_sum(each, None, ["last", "source"], "one", "mix-ranks").withColumnRenamed("position", "source_rank")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    each = each.withColumn("weight", F.element_at(cycle, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    each = written(each.select("source", "source_rank", "weight", "source_size", (F.col("source_size") * repeats).alias("top")), "mix-sources")
    all_of = each.agg(F.sum("source_size").alias("budget"), F.sum("weight").alias("weight")).first()
    budget, held, level = all_of["budget"] or 0, 0, (all_of["budget"] or 0) / (all_of["weight"] or 1)
    while True:
        above = F.col("weight") * F.lit(level) > F.col("top")
        now = each.agg(F.count_if(above).alias("held"), F.sum(F.when(above, F.col("top"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if now["held"] == held or not now["open"]:
            break
        held, level = now["held"], (budget - now["full"]) / now["open"]
    target = F.least(F.col("weight") * F.lit(level), F.col("top").cast("double"))
    return each.select("source", "source_rank", "weight", "source_size", F.lit(budget).cast("long").alias("budget"), target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, with_file: bool = False) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, passes (times that it is taken) and, ``with_file``, its locator."""
    with cleared(docs.sparkSession) as keep:
        return keep(_mix(docs, doc_id, text, source, seed, weights, repeats, with_file), "mix")


def _mix(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, weights: tuple[int, ...], repeats: int, with_file: bool) -> DataFrame:
    rows = located(docs, {"doc_id": F.col(f"`{doc_id}`"), "source": F.col(f"`{source}`"), "text": F.col(f"`{text}`")}, "mix-input")
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    file = ["at_file"] if with_file else []
    sizes = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(name).alias("place"), F.xxhash64("at_file").alias("file"), "at_row", *file)
    sizes = written(sizes, "mix-sizes")
    sources = source_targets(sizes, weights, repeats)
    docs = sizes.join(maybe_broadcast(sources), sizes["source"].eqNullSafe(sources["source"])).drop("source")
    queued = running_sum(docs, "source_rank", ["place", "file", "at_row"], "size", "mix-queue")

    def finish(turn):
        return ((turn - 1) * F.col("source_size") + F.col("running")) / F.col("weight")

    turns = queued.select(F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("turn"), "source_rank", "source_size", "weight", "size", "running", "budget", F.col("position").alias("at"))
    turns = turns.select(finish(F.col("turn")).alias("finish"), "source_rank", "turn", "at", "size", "budget")
    order = ["finish", "source_rank", "turn", "at"]
    inside = running_sum(turns, None, order, "size", "mix-passes").where("running <= budget")
    cut = inside.agg(F.max(F.struct(*order)).alias("cut"))
    passes = sum((F.when(F.struct(finish(F.lit(t)).alias("finish"), F.col("source_rank"), F.lit(t).alias("turn"), F.col("position").alias("at")) <= F.col("cut"), 1).otherwise(0) for t in range(2, repeats + 1)), F.when(F.struct(finish(F.lit(1)).alias("finish"), F.col("source_rank"), F.lit(1).alias("turn"), F.col("position").alias("at")) <= F.col("cut"), 1).otherwise(0))
    out = queued.join(F.broadcast(cut)).withColumn("passes", passes)  # the cut is one row
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", *(["at_file", "at_row"] if with_file else []))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    rows = Rows(docs, "mix-rows")
    found = mix(rows.plain, rows.own(doc_id), rows.own(text), rows.own(source), with_file=True)
    # most rows are taken once: only the others are looked up
    other = written(found.where("passes != 1").select("at_file", "at_row", "passes"), "mix-other")
    times = F.coalesce("passes", F.lit(1))
    taken = rows.located.join(maybe_broadcast(other), ["at_file", "at_row"], "left").where(times > 0)
    return rows.back(taken.withColumn("turn", F.explode(F.sequence(F.lit(1), times))))


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size, md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), named AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (rk - 1) % 3 + 1 AS w, 3 * source_size AS top, (sum(source_size) OVER ())::bigint AS budget FROM named
), filled AS (
  SELECT *, (sum(top) OVER (ORDER BY top / w, rk) - top)::bigint AS full_words, (sum(w) OVER () - sum(w) OVER (ORDER BY top / w, rk) + w)::bigint AS open_weight FROM weighed
), levels AS (
  SELECT *, (budget - full_words) / open_weight AS level FROM filled
), chosen AS (
  SELECT *, (SELECT arg_min(level, rk_fill) FROM (SELECT level, row_number() OVER (ORDER BY top / w, rk) AS rk_fill, w * level <= top AS fits FROM levels) WHERE fits) AS chosen_level FROM levels
), targets AS (
  SELECT source, rk, w, source_size, budget, least(w * chosen_level, top::double) AS target FROM chosen
), queued AS (
  SELECT s.doc_id, s.size, t.*, (sum(s.size) OVER (PARTITION BY t.rk ORDER BY place ROWS UNBOUNDED PRECEDING))::bigint AS running,
         row_number() OVER (PARTITION BY t.rk ORDER BY place) AS pos
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT q.*, turn, ((turn - 1) * source_size + running) / w AS finish FROM queued q, (VALUES (1), (2), (3)) v(turn)
), sorted AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rk, turn, pos ROWS UNBOUNDED PRECEDING) AS total FROM passes
)
SELECT doc_id, size::bigint AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       (size * count(*) FILTER (total <= budget))::bigint AS taken, count(*) FILTER (total <= budget)::integer AS passes
FROM sorted GROUP BY rk, pos, doc_id, size
"""
