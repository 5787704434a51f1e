"""Files in stores that tasks reach by URI: byte ranges of a file, and a sink that commits.

URIs are those of Spark's file listings (``file:/...``, ``hdfs://...``, ``s3a://...``) or plain paths; pyarrow opens them.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a page of a file, the pages of a file that stay in memory.
PAGE, PAGES = 16 << 10, 64
#: Folder of files that aren't committed yet, inside the sink's folder; listings leave it out by its name.
PENDING = "_pending"


def opened(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri) if re.match(r"^\w[\w+.-]+:", uri) else (fs.LocalFileSystem(), uri)


class Ranged:
    """A file that is read by slices, like bytes: short slices from a few cached pages, long ones by one read."""

    def __init__(self, uri: str):
        where, path = opened(uri)
        self.file, self.pages, self.bytes_read = where.open_input_file(path), {}, 0

    def _read(self, at: int, n: int) -> bytes:
        raw = self.file.read_at(n, at)
        self.bytes_read += len(raw)
        return raw

    def whole(self) -> bytes:
        return self._read(0, self.file.size())

    def __getitem__(self, part: slice) -> bytes:
        low, high = part.start or 0, part.stop
        if high - low > PAGE:
            return self._read(low, high - low)
        out = b""
        for k in range(low // PAGE, (max(high, low + 1) - 1) // PAGE + 1):
            if k not in self.pages:
                if len(self.pages) >= PAGES:
                    self.pages.pop(next(iter(self.pages)))
                self.pages[k] = self._read(k * PAGE, PAGE)
            out += self.pages[k]
        return out[low % PAGE : low % PAGE + high - low]


@dataclass
class Landed(WriterCommitMessage):
    """What a task has put down: its folder and the names in it."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Each task writes into a folder of its own; only the commit moves files to where readers look."""

    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.at = [names.index(c) for c in ("name", "data")]
        self.job = f"{self.folder}/{PENDING}/{uuid.uuid4().hex}"
        where, job = opened(self.job)
        where.create_dir(job, recursive=True)  # tasks that outlive an aborted job can't make it again

    def write(self, rows: Iterator) -> Landed:
        where, top = opened(f"{self.job}/{uuid.uuid4().hex}")
        where.create_dir(top, recursive=False)
        names = []
        for row in rows:
            name, data = (row[k] for k in self.at)
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} can't be the name of a file")
            with where.open_output_stream(f"{top}/{name}") as f:
                f.write(bytes(data or b""))
            names.append(name)
        return Landed(top, names)

    def commit(self, messages: list[Landed | None]) -> None:
        from pyarrow import fs

        where, folder = opened(self.folder)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        where.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(folder)):
                if old.type == fs.FileType.File and old.base_name not in names:
                    where.delete_file(old.path)
        for m in done:
            for n in m.names:
                where.move(f"{m.folder}/{n}", f"{folder}/{n}")
        self._cleared()

    def abort(self, messages: list[Landed | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        """Deletes the job's folder, and that of pending jobs if it was the last; tasks that are being stopped may still add to it."""
        from pyarrow import fs

        where, pending = opened(self.job)
        top = pending.rpartition("/")[0]
        for wait in (0.0, 0.1, 0.3, 1.0):
            time.sleep(wait)
            try:
                if where.get_file_info(pending).type == fs.FileType.Directory:
                    where.delete_dir(pending)
                if where.get_file_info(top).type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(top)):
                    where.delete_dir(top)
                return
            except OSError:
                continue


class Files(DataSource):
    """Sink of rows (name, data), one file each: ``df.write.format("fieldloom_files").mode("append").save(folder)``.

    Nothing is seen before the commit, which moves the files by name; ``overwrite`` then deletes the folder's other files. A task that fails
    or is tried again leaves nothing. Null data is an empty file; names of folders, hidden names and a name given twice raise.
    """

    @classmethod
    def name(cls) -> str:
        return "fieldloom_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], schema.names, overwrite)


def put(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes rows (name, data) as files of ``folder``, and lists what is there."""
    spark = files.sparkSession
    spark.dataSource.register(Files)
    files.select("name", "data").write.format("fieldloom_files").mode("overwrite" if overwrite else "append").option("path", folder).save()
    return listed(spark, folder)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, length) of the files of a folder that aren't empty; nothing of them is read."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
