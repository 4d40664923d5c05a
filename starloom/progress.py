"""Reports of a running batch job's progress, task by task."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def told(spark: SparkSession, tell: Callable[[int, int], None] | None, seconds: float = 0.2) -> Iterator[None]:
    """While the block's jobs run, call tell(tasks done, tasks begun or waiting) whenever the first number has grown."""
    if tell is None:
        yield
        return
    context, group, over = spark.sparkContext, f"told-{uuid.uuid4().hex}", threading.Event()
    before = context.getLocalProperty("spark.jobGroup.id")

    def counted() -> tuple[int, int]:
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        known = [i for s in stages if (i := tracker.getStageInfo(s))]
        return sum(i.numCompletedTasks for i in known), sum(i.numTasks for i in known)

    def watch() -> None:
        told_last = 0
        while not over.wait(seconds):
            done, total = counted()
            if done > told_last:
                tell(done, total)
                told_last = done

    watcher = threading.Thread(target=watch, daemon=True)
    context.setLocalProperty("spark.jobGroup.id", group)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", before)
