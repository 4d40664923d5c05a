"""Continuous imports: each micro-batch replaces its source's tables once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Canon


def import_batches(stream: DataFrame, canon: Canon, source: str, tables: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Run `tables` on every batch and swap its results in; a batch that the ledger has is passed over."""

    def once(batch: DataFrame, number: int) -> None:
        if not canon.imported(source, str(number)):
            canon.replace(tables(batch), source, str(number))

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

