"""Exact deduplication batch by batch: the state of the stream is kept in a folder and met again by later documents.

The folder holds the fingerprints of all documents (identifier, length, digest, content locator), the stream's checkpoint with its
disk-backed state of one entry for each digest, without expiry, and what each micro-batch changed. ``add`` appends the fingerprints of
new documents and runs the stream over them only; a digest that was seen in any earlier batch is a hit. Hits are checked on
the full bytes, which are read again through the locators of all documents that bear the digest, old and new; texts that only share
a digest are groups of their own.

Defined cases: as in ``exact_dedup``; documents whose files are gone can't be compared, so a hit on them raises; an empty batch
changes nothing; a batch that is added twice counts twice.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, maybe_broadcast, written
from .exact_dedup import _STATE, _keep_order, normalised, sha256_of


class DedupState:
    """The state in ``folder``, which the driver and all executors share; opened again, it goes on."""

    def __init__(self, spark: SparkSession, folder: str, digest=sha256_of):
        self.spark, self.folder, self.digest = spark, folder.rstrip("/"), digest

    def _prints(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/prints")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, at_file, at_row, against all documents so far."""
        batch, column = uuid.uuid4().hex, text
        columns = {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`")}
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
        except AnalysisException:  # not rows of files: their texts are kept here
            kept = f"{self.folder}/texts/{batch}"
            docs.select(*[c.alias(k) for k, c in columns.items()]).write.parquet(kept)
            docs, columns, column = self.spark.read.parquet(kept), {k: F.col(k) for k in columns}, "text"
        plain = normalised(F.col("text"))
        points = F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points")
        source = located(docs, columns, "dedup-batch")
        prints = source.select("doc_id", points, self.digest(plain).alias("key"), sha256_of(plain).alias("text_sha256"), "at_file", "at_row", F.lit(column).alias("text_column"), F.lit(batch).alias("batch"))
        prints.write.mode("append").parquet(f"{self.folder}/prints")
        self._run(prints.schema)
        return self.classes(batch)

    def _run(self, schema) -> None:
        """The stream over the fingerprints that it hasn't seen."""
        spark, before = self.spark, {k: self.spark.conf.get(k, None) for k in _STATE}

        def emit(changed: DataFrame, number: int) -> None:
            changed.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/state/at={number}")

        for k, v in _STATE.items():
            spark.conf.set(k, v)
        try:
            state = spark.readStream.schema(schema).parquet(f"{self.folder}/prints").groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min(_keep_order()).alias("keep"))
            stream = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).foreachBatch(emit).start()
            stream.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        """The last entry of each digest: key, group_size, keep."""
        rows = self.spark.read.parquet(f"{self.folder}/state").drop("at")
        return rows.groupBy("key").agg(F.max_by(F.struct("group_size", "keep"), "number").alias("last")).select("key", "last.*")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """Texts of the rows (at_file, at_row, text_column, ...) by their locators."""
        out = None
        for column in [r[0] for r in wanted.select("text_column").distinct().collect()]:  # as many as there are names of the text column
            files = [r[0] for r in wanted.where(F.col("text_column") == column).select("at_file").distinct().collect()]  # a name for each file that holds a hit
            rows = located(self.spark.read.parquet(*files), {"text": F.col(f"`{column}`")}, "dedup-texts")
            part = wanted.where(F.col("text_column") == column).join(rows, ["at_file", "at_row"])
            out = part if out is None else out.unionByName(part)
        return out

    def classes(self, batch: str | None = None) -> DataFrame:
        """Rows of a batch, or of all documents so far: doc_id, keep_id, group_size, kept, text_sha256, at_file, at_row."""
        names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "at_file", "at_row"]
        entries, prints = self.entries(), self._prints()
        mine = prints if batch is None else prints.where(F.col("batch") == batch)
        hits = entries.where("group_size > 1").join(mine.select("key").distinct(), "key", "left_semi").select("key")
        bearing = written(prints.join(maybe_broadcast(written(hits, "dedup-hits")), "key", "left_semi"), "dedup-bearing")
        found = mine.join(entries, "key")
        if not bearing.isEmpty():
            texts = self._texts(bearing).withColumn("plain", normalised(F.col("text")))
            read, known = texts.count(), bearing.count()
            if read < known:
                raise FileNotFoundError(f"{known - read} texts of repeated digests are gone")
            several = texts.groupBy("key", "plain").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key")
            split = written(several, "dedup-split")
            if not split.isEmpty():
                apart = texts.join(split, "key", "left_semi")
                groups = apart.groupBy("key", "plain").agg(F.count(F.lit(1)).alias("group_size"), F.min(_keep_order()).alias("keep"))
                own = apart.join(groups, ["key", "plain"]).select("at_file", "at_row", "batch", "group_size", "keep")
                again = mine.join(split, "key", "left_semi").join(own, ["at_file", "at_row", "batch"])
                found = found.join(split, "key", "left_anti").unionByName(again.select(*found.columns))
        kept: Column = (F.col("keep.at_file") == F.col("at_file")) & (F.col("keep.at_row") == F.col("at_row"))
        return written(found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "at_file", "at_row").select(*names), "dedup-classes")
