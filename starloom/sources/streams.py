"""Wanted streams of a multi-stream bzip2 archive, each read from its place in the file; the others aren't touched."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dumps
from .archives import opened

#: Most compressed bytes that are read of one stream, and how many at a time.
STREAM_BUDGET, CHUNK = 8 << 20, 256 << 10


def ranges(index: DataFrame) -> DataFrame:
    """(offset, until): where each stream begins and the next one does. Offsets are sorted by range; the last one of
    each task doesn't know the next (null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = []
        for b in batches:
            at = last + b.column("offset").to_pylist()
            last = at[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(at[:-1], pa.int64()), pa.array(at[1:], pa.int64())], ["offset", "until"])
        yield pa.RecordBatch.from_arrays([pa.array(last, pa.int64()), pa.nulls(len(last), pa.int64())], ["offset", "until"])

    return index.select("offset").distinct().sort("offset").mapInArrow(rows, "offset bigint, until bigint")


def stream(file, offset: int, until: int | None) -> bytes:
    """What one stream says, as far as it can be read: up to its own end, the next one's start or the budget."""
    file.seek(offset)
    left, decoder, out = min(STREAM_BUDGET, until - offset if until is not None else STREAM_BUDGET), bz2.BZ2Decompressor(), []
    while left > 0 and not decoder.eof and (data := file.read(min(left, CHUNK))):
        left -= len(data)
        try:
            out.append(decoder.decompress(data))
        except OSError:  # damaged: what came before stays
            break
    return b"".join(out)


def texts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(value): the decompressed text of each wanted stream(offset, until); neighbours in the file are read by one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for b in batches:
            for offset, until in zip(b.column("offset").to_pylist(), b.column("until").to_pylist(), strict=True):
                file = file or opened(path)
                yield pa.RecordBatch.from_arrays([pa.array([stream(file, offset, until).decode("utf-8", "replace")], pa.string())], ["value"])

    return wanted.select("offset", "until").repartitionByRange("offset").sortWithinPartitions("offset").mapInArrow(rows, "value string")


def pages(spark: SparkSession, path: str, index: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, revision_id, text) of the pages in the streams that hold the wanted titles(title), by the archive's
    index(offset, page_id, title); pages beside them in a stream come too."""
    wanted = ranges(index).join(dumps.wanted_streams(index, titles).select("offset"), "offset", "left_semi")
    found = texts(spark, path, wanted).select(F.explode(F.split("value", "<page>")).alias("value"))
    return dumps.pages(found.select(F.substring_index("value", "</page>", 1).alias("value")))
