"""Tables in the folder that the driver and all executors share, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that names none gets a folder of its own.

    On a cluster the setting is required: a folder of one machine would lose what executors write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Measured bytes up to which a table is sent to every executor.
BROADCAST_BYTES = 16 << 20


#: Paths made since the innermost ``cleared`` of this thread began; other threads have their own.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/fieldloom/{name}-{uuid.uuid4().hex[:12]}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a result as a table that stays; all other paths made meanwhile are deleted in the end."""
    outer = _MADE.get()
    made: list[str] = []
    token = _MADE.set(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return written(df, name)
        finally:
            _MADE.reset(inner)

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a joined row."""
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(F.transform(value, lambda x: _width(x, kind.elementType)), F.lit(16).cast("long"), lambda s, x: s + x), F.lit(16))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    return F.lit(8).cast("long")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast when its measured bytes are within ``limit``; else it stays as it is."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a table so that neither side of its join is sent whole: Spark's own guess knows neither exploded rows nor what compressed files hold."""
    return df.hint("merge")


def by_size(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast when its measured bytes are within ``limit``, else its join for a shuffle of both sides."""
    marked = maybe_broadcast(df, limit)
    return shuffled(df) if marked is df else marked
