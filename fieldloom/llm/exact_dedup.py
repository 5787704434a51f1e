"""Exact deduplication as a stateful stream.

Every document becomes a fingerprint row: SHA-256 of its normalised text, identifier, length and a content
locator (file and row). A stream over the fingerprints keeps one entry for each digest in a disk-backed state
store (RocksDB), without expiry: the digest, the number of rows, and identifier and locator of the row that
stays. Digests that were hit again are then verified on the full bytes: the texts behind them are read once
more and compared whole, copies being collapsed before the shuffle. Should different texts share a digest,
each text becomes a group of its own.

Cost: two scans of the text column, one shuffle of fingerprints, one of the texts that have copies.

Defined cases: a null text counts as empty; all empty texts are one group; a null identifier sorts last; of
rows equal in everything, the one with the smallest locator stays; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.storage import cleared

from .common import Rows, located, maybe_broadcast, scratch, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
}


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _keep_order(at_file: str = "at_file", at_row: str = "at_row") -> Column:
    """Smallest first: most code points, then smallest identifier, nulls last, then the locator."""
    return F.struct(
        (-F.col("n_points")).alias("less"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        F.col(at_file),
        F.col(at_row),
    )


def _streamed_state(spark: SparkSession, log: str, schema, digests: str) -> DataFrame:
    """Run the stateful stream over the fingerprint log; one row for each digest."""
    out, batches = scratch(spark, "dedup-state"), []
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)

    def emit(changed: DataFrame, batch: int) -> None:
        batches.append(batch)
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/at={batch}")

    try:
        state = (
            spark.readStream.schema(schema)
            .parquet(log)
            .groupBy(digests)
            .agg(F.count(F.lit(1)).alias("group_size"), F.min(_keep_order()).alias("keep"))
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", scratch(spark, "dedup-stream"))
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not batches:
        return spark.createDataFrame([], state.schema)
    rows = spark.read.schema(f"{digests} string, group_size long, keep {state.schema['keep'].dataType.simpleString()}, batch long").parquet(*[f"{out}/at={b}" for b in sorted(set(batches))])
    if len(set(batches)) > 1:  # a digest changed in several batches: its last entry counts
        rows = rows.groupBy(digests).agg(F.max_by(F.struct("group_size", "keep"), "batch").alias("last")).select(digests, "last.*")
    return rows.select(digests, "group_size", "keep")


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and its locator at_file, at_row.

    ``digest`` gives the key of the state from the normalised text. A short one makes collisions, which the
    comparison of full bytes takes apart.
    """
    with cleared(docs.sparkSession) as keep:
        return keep(_classes(docs, doc_id, text, digest), "dedup")


def _classes(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    spark = docs.sparkSession
    source = located(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`")}, "dedup-input")
    plain = normalised(F.col("text"))
    log = scratch(spark, "dedup-log")
    points = F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points")
    prints = source.select("doc_id", points, digest(plain).alias("key"), sha256_of(plain).alias("text_sha256"), "at_file", "at_row")
    if digest is sha256_of:
        prints = prints.drop("key").withColumn("key", F.col("text_sha256"))
    prints.write.parquet(log)
    prints = spark.read.schema(prints.schema).parquet(log)
    state = _streamed_state(spark, log, prints.schema, "key")

    hits = state.where("group_size > 1").select("key")
    texts = source.select("doc_id", points, plain.alias("plain"), "at_file", "at_row").withColumn("key", digest(F.col("plain")))
    texts = texts.join(maybe_broadcast(hits), "key", "left_semi")
    classes = texts.groupBy("key", "plain").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    split = classes.where("texts > 1").select("key")
    split = written(split, "dedup-split")

    found = prints.join(state, "key")
    if not split.isEmpty():
        apart = texts.join(split, "key", "left_semi")
        groups = apart.groupBy("key", "plain").agg(F.count(F.lit(1)).alias("group_size"), F.min(_keep_order()).alias("keep"))
        apart = apart.join(groups, ["key", "plain"]).select("at_file", "at_row", "group_size", "keep")
        again = prints.join(split, "key", "left_semi").join(apart, ["at_file", "at_row"])
        found = found.join(split, "key", "left_anti").unionByName(again.select(*found.columns))
    kept = (F.col("keep.at_file") == F.col("at_file")) & (F.col("keep.at_row") == F.col("at_row"))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "at_file", "at_row")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    rows = Rows(docs, "dedup-rows")
    found = exact_dedup(rows.plain, rows.own(doc_id), rows.own(text))
    return rows.without(written(found.where(~F.col("kept")).select("at_file", "at_row"), "dedup-dropped"))
