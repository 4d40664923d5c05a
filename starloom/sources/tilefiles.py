"""Rows (path, part, content) as one file for each path, by a Python data source writer that commits by task."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .archives import store_of


@dataclass
class _Done(WriterCommitMessage):
    """What a task has written: its folder, and the paths of the files in it."""

    folder: str
    paths: list[str]


class ContentFiles(DataSource):
    """Option path: the folder. The parts of a path have to be one task's, in their order."""

    @classmethod
    def name(cls) -> str:
        return "content_files"

    def schema(self) -> str:
        return "path string, part int, content binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    """A task writes to a folder of its own beside the files. When all tasks are done their files are moved to where they
    belong, over older ones; if the job fails its folders go, and the files are as they were."""

    def __init__(self, root: str):
        self._root, self._drafts = root, posixpath.join(root, f"_drafts-{uuid.uuid4().hex}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder = posixpath.join(self._drafts, uuid.uuid4().hex)
        where, at = store_of(folder)
        paths, file = [], None
        try:
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    if not paths or path != paths[-1]:
                        if file:
                            file.close()
                        where.create_dir(posixpath.dirname(posixpath.join(at, path)), recursive=True)
                        file = where.open_output_stream(posixpath.join(at, path))
                        paths.append(path)
                    file.write(content.as_buffer())
        finally:
            if file:
                file.close()
        return _Done(folder, paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = store_of(self._root)
        for m in (m for m in messages if m):
            at = store_of(m.folder)[1]
            for folder in {posixpath.dirname(p) for p in m.paths}:
                where.create_dir(posixpath.join(root, folder), recursive=True)
            for p in m.paths:
                where.move(posixpath.join(at, p), posixpath.join(root, p))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, at = store_of(self._drafts)
        if where.get_file_info(at).type.name != "NotFound":
            where.delete_dir(at)


def write(files: DataFrame, folder: str) -> None:
    """files(path, part, content): a path's parts are brought together and follow each other in its file. Older files of
    other paths stay."""
    files.sparkSession.dataSource.register(ContentFiles)
    rows = files.select("path", "part", "content").repartition("path").sortWithinPartitions("path", "part")
    rows.write.format("content_files").mode("append").save(folder)
