"""What the operators of this package share: shared-folder tables, row locators, checked broadcasts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.storage import maybe_broadcast, scratch, written  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that a Python worker is given at once, at most (a row that is larger goes alone).
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes for Python: rows here hold whole documents or packed sets, in the JVM and the worker.

    They stay lowered, since a lazy result is planned only when its user writes it, and are never raised, so queries
    that run at the same time don't change each other's batches.
    """
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    bound = spark.conf.get(_BYTES)
    if not (bound.isdigit() and 0 < int(bound) <= BATCH_BYTES):
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def located(docs: DataFrame, columns: dict[str, Column], name: str) -> DataFrame:
    """``columns`` of ``docs`` with a locator of each row: ``at_file`` and ``at_row``.

    Rows of a Parquet scan are located in place; any other input is first written to the shared folder.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        here = {"at_file": meta["file_path"], "at_row": meta["row_index"]}
        return docs.select(*[c.alias(k) for k, c in {**columns, **here}.items()])
    except AnalysisException:
        kept = written(docs.select(*[c.alias(k) for k, c in columns.items()]), name)
        return located(kept, {k: F.col(k) for k in columns}, name)


class Rows:
    """All rows of ``docs`` under names of our own (c0, c1, ...), so that no column's name clashes, with locators."""

    def __init__(self, docs: DataFrame, name: str):
        self.names = docs.columns
        own = [f"c{i}" for i in range(len(self.names))]
        self.located = located(docs.toDF(*own), {c: F.col(c) for c in own}, name)
        self.plain = self.located.drop("at_file", "at_row")

    def own(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns and names of ``docs``."""
        return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)])

    def without(self, dropped: DataFrame) -> DataFrame:
        """The rows whose locators aren't in ``dropped``."""
        return self.back(self.located.join(maybe_broadcast(dropped.select("at_file", "at_row")), ["at_file", "at_row"], "left_anti"))


def words_pattern() -> str:
    """Java pattern of a word: a run of anything but space and the controls from tab to carriage return."""
    return "[^ \\t-\\r]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")
