"""Members of tar archives as lines, by a Python data source: one task an archive, streamed, other members passed over."""

from __future__ import annotations

import bz2
import gzip
import re
import tarfile
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, member string, line bigint, value string"
BATCH = 4096  # lines
END_MARK = (b"\\.", b"\\.\r")
_NAMES = ["archive", "member", "line", "value"]


def is_tar(path: str) -> bool:
    return re.search(r"\.(?:tar(?:\.(?:bz2|gz))?|tgz|tbz2?)$", path) is not None


def store_of(path: str) -> tuple:
    """(file system, path in it) of any store that pyarrow knows."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)


def opened(path: str) -> IO[bytes]:
    """A file opened for reading at any place."""
    where, at = store_of(path)
    return where.open_input_file(at)


def unpacked(path: str) -> tarfile.TarFile:
    """The archive as a stream. Both decoders go on over the members of a file that was compressed in pieces, at whose
    first end a tar reader's own decoder stops."""
    file = opened(path)
    if re.search(r"bz2?$", path):
        file = bz2.BZ2File(file)
    elif re.search(r"gz$", path):
        file = gzip.GzipFile(fileobj=file)
    return tarfile.open(fileobj=file, mode="r|")


class TarLines(DataSource):
    """Options: path (archives, comma between them), members (patterns of names, comma between them; all if missing),
    end_mark (true: a member ends at a lone \\. in its line)."""

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._paths = options["path"].split(",")
        self._patterns = [p for p in options.get("members", "").split(",") if p]
        self._names: list[set[str]] = []
        self._end_mark = options.get("end_mark", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Names that a query asks for are looked for in the archive; all other conditions are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("member",):
                self._names.append({f.value})
            elif isinstance(f, In) and f.attribute == ("member",):
                self._names.append(set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self._paths]

    def _wanted(self, name: str) -> bool:
        return (not self._patterns or any(fnmatch(name, p) for p in self._patterns)) and all(name in names for names in self._names)

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        archive = unpacked(partition.path)
        for member in archive:
            if member.isfile() and self._wanted(member.name):
                yield from _batches(partition.path, member.name, self._lines(archive.extractfile(member)))

    def _lines(self, member: IO[bytes]) -> Iterator[bytes]:
        for line in member:
            line = line.removesuffix(b"\n")
            if self._end_mark and line in END_MARK:
                return
            yield line


def _batches(archive: str, member: str, lines: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    first, held = 0, []

    def batch() -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in held], pa.string())], _NAMES)

    for line in lines:
        held.append(line)
        if len(held) == BATCH:
            yield batch()
            first, held = first + BATCH, []
    if held:
        yield batch()


def lines(spark: SparkSession, path: str, members: list[str], end_mark: bool = False) -> DataFrame:
    """(archive, member, line, value) of the members whose names fit one of the patterns. Spark hands conditions to a
    Python source only where the session lets it, so that setting is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarLines)
    return spark.read.format("tar_lines").option("members", ",".join(members)).option("end_mark", str(end_mark).lower()).load(path)


def timestamp(spark: SparkSession, path: str) -> str | None:
    """What the member TIMESTAMP says, as the version of the export."""
    row = lines(spark, path, ["TIMESTAMP", "*/TIMESTAMP"]).select("value").first()
    return row.value.strip() if row else None
