"""Helpers that the corpus operators share: inputs, bounded batches and labelled samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..staging import discard as discard
from ..staging import stage as stage

#: Rows that Spark hands to Python at once; texts are whole, so this bounds a worker's memory.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """rows.mapInArrow() in batches of few rows, as texts may be long. Spark knows no option of a single query for that,
    and reads the session's when a plan runs; so that one is lowered, never raised, and stays lowered."""
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return rows.mapInArrow(function, schema)


def appended(docs: DataFrame, name: str, score: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """All columns of the rows and score(texts) as a double, in place of a column of that name if there is one."""
    kept = docs.drop(name)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts_of(part)), pa.float64())], [*part.schema.names, name])

    return bounded_batches(kept, rows, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int = 20_000) -> DataFrame:
    """(text, y): at most `per_class` training texts of each class, chosen by a hash of the id.

    Only rows outside fold 0 count. Null labels, null texts and repeated ids are left out, and so are texts over
    `max_chars`, which bounds the sample at 2 x per_class x max_chars characters.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    picked = picked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = [picked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    keys = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return texts.join(F.broadcast(keys), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def trained_in_a_task(sample: DataFrame, train: Callable[[list[tuple[str, int]]], object]) -> object:
    """train(sample) by a task, from rows (doc_id, text, y) of a bounded sample in the order of doc_id. The driver, which
    runs on for long and coordinates, holds what was learnt but neither the texts nor what training needs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([x[1:] for x in sorted(held)]))], pa.binary())], ["model"])

    made = bounded_batches(sample.repartition(1), rows, "model binary").first()
    return pickle.loads(made.model) if made else train([])  # Spark may run no task over no rows


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def in_parts(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a part holds about `most_bytes` of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
