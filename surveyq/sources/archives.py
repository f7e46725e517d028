"""Zip archives by ranges of their members: one archive is many tasks, and none holds it whole.

The directory at the end of a zip names each member and its place, so ranges of it are
read side by side. Paths are opened by Arrow's file systems (local, S3, GCS, Azure, HDFS with
its library); for stores that only Spark's readers open there is surveys.archive_members.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Packed bytes that a task reads.
TASK_BYTES = 32 << 20
SCHEMA = "archive string, name string, content string"


def safe_json(name: str) -> bool:
    """Whether a member is a .json file whose name stays inside the folder it would be unpacked to."""
    return name.lower().endswith(".json") and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


@dataclass
class MemberRange(InputPartition):
    """Members a to b of an archive, by their order in its directory."""

    archive: str
    a: int
    b: int


class _File(io.RawIOBase):
    """An Arrow file as Python's own: places before its start are an OSError, as zipfile expects of small files."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self._file, self._at = store.open_input_file(path), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self._at, self._file.size())[whence]
        if at < 0:
            raise OSError("place before the start of the file")
        self._at = at
        return at

    def tell(self) -> int:
        return self._at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self._file.size() - self._at))
        buffer[:n] = self._file.read_at(n, self._at)
        self._at += n
        return n

    def close(self) -> None:
        self._file.close()
        super().close()


def _opened(uri: str) -> io.BufferedReader:
    return io.BufferedReader(_File(uri), 1 << 16)


def archives_of(uri: str) -> list[str]:
    """The .zip files that are uri, or lie in it at any depth, in order."""
    store, path = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(path)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    if info.type == fs.FileType.File:
        return [uri]
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


def ranges(archive: str, task_bytes: int) -> list[MemberRange]:
    """An archive's members in ranges of about task_bytes packed bytes; only the directory is read."""
    out, a, size = [], 0, 0
    with _opened(archive) as file, zipfile.ZipFile(file) as z:
        members = z.infolist()
    for i, m in enumerate(members):
        if i > a and size + m.compress_size > task_bytes:
            out.append(MemberRange(archive, a, i))
            a, size = i, 0
        size += m.compress_size
    return [*out, MemberRange(archive, a, len(members))] if members else out


class ZipReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[MemberRange]:
        return [r for archive in archives_of(self.path) for r in ranges(archive, self.task_bytes)] or [MemberRange("", 0, 0)]

    def read(self, partition: MemberRange) -> Iterator[tuple[str, str, str]]:
        if partition.a == partition.b:
            return
        with _opened(partition.archive) as file, zipfile.ZipFile(file) as z:
            for m in z.infolist()[partition.a : partition.b]:
                if not m.is_dir() and safe_json(m.filename):
                    yield partition.archive, m.filename, z.read(m).decode("utf-8", "replace")


class ZipMembers(DataSource):
    """spark.read.format("zip_members").option("path", ...): (archive, name, content) of .json members; unsafe names are left out."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def read_zips(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, name, content) of the .json members of the zips at or under a path with a scheme; none where there is no archive."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("path", path).option("task_bytes", task_bytes).load()


def write_zips(df: DataFrame, folder: str, name: str, content: str) -> int:
    """A zip in folder for each partition of df, its rows as members; returns the number of rows. Null contents are empty.

    A task writes beside the final name and renames at its end, so a task that runs again replaces its archive.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        part, mine = f"{path}/part-{context.partitionId():05d}.zip", f"{path}/attempt-{context.taskAttemptId()}"
        rows = 0
        with store.open_output_stream(mine) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in batches:
                for n, c in zip(pdf["name"], pdf["content"]):
                    z.writestr(n, c if isinstance(c, str) else "")
                rows += len(pdf)
        store.move(mine, part) if rows else store.delete_file(mine)
        yield pd.DataFrame({"rows": [rows]})

    return df.select(df[name].cast("string").alias("name"), df[content].cast("string").alias("content")).mapInPandas(write, "rows long").agg({"rows": "sum"}).head()[0] or 0
