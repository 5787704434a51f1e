"""A change log with one commit for each change: versions are made whole or not at all, and one of two writers wins.

A change's rows, puts and deletes together, are first written to a folder of their own, which no reader sees. The commit is a
file named by the next version, created only if it is absent, that names the folder. Who finds it there has lost: another
change was committed since it read, so it raises ``Conflict`` and leaves nothing. Readers take the folders of
committed versions only. The file system must create files exclusively, as HDFS and local ones do; object stores that don't need a
committer that does.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import catalog
from fieldloom.storage import deleted as drop_path


class Conflict(RuntimeError):
    """Another writer committed the version."""


class ChangeLog:
    """The log at ``path`` of a table with a key. Each version's rows say ``version`` and ``deleted``."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._commits = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        self._store = self._commits.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, dict]:
        """Committed versions in order: what their files say. A file without content is of a writer that died."""
        if not self._store.exists(self._commits):
            return {}
        out = {}
        for status in sorted(self._store.listStatus(self._commits), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if name.isdigit():
                said = self._read(status.getPath())
                out[int(name)] = json.loads(said) if said else {"folder": None}
        return out

    def _read(self, path) -> str:
        stream = self._store.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def commit(self, put: DataFrame | None = None, gone: DataFrame | None = None, after: int | None = None) -> int:
        """One version: the rows of ``put`` are inserted or replace those of their key, those of ``gone`` are deleted, puts winning.

        ``after`` is the version that the change was made from, the latest one if None; a log that has gone on raises Conflict.
        """
        after = self.latest() if after is None else after
        version = after + 1
        parts = [rows.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(dead)}) for rows, dead in ((put, False), (gone, True)) if rows is not None]
        folder = f"{self.path}/rows/{version:020d}-{uuid.uuid4().hex}"
        try:
            if parts:
                reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.parquet(folder)
            self._claim(version, {"folder": folder if parts else None})
        except BaseException:
            drop_path(self.spark, folder)
            raise
        return version

    def _claim(self, version: int, said: dict) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._commits, f"{version:020d}")
        try:
            stream = self._store.create(path, False)
        except Py4JJavaError as e:
            if self._store.exists(path):
                raise Conflict(f"version {version} is another writer's") from e
            raise
        try:
            stream.write(bytearray(json.dumps(said).encode()))
        finally:
            stream.close()

    def rows(self, upto: int | None = None) -> DataFrame:
        """All rows of the committed versions, up to ``upto``; raises on a log without any."""
        folders = [v["folder"] for k, v in self.versions().items() if v["folder"] and (upto is None or k <= upto)]
        if not folders:
            raise LookupError(f"{self.path} has no committed rows")
        return self.spark.read.option("mergeSchema", "true").parquet(*folders)

    def table(self, upto: int | None = None) -> DataFrame:
        """The table as of a version, the latest one if None."""
        return catalog.current(self.rows(upto), self.key)

    def replace(self, new: DataFrame, group: str, value) -> int:
        """All rows of a group become ``new``, in one commit; an empty ``new`` empties it."""
        after = self.latest()
        gone = self.table(after).where(F.col(group) == value) if any(v["folder"] for v in self.versions().values()) else None
        return self.commit(new, gone, after)
