"""Tables written to the shared folder, so that lineage ends there and lost executors cost little."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One is made only where none is set and all runs on this machine (tests); on
    a cluster executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="starloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows, written once and read from there; by: a column of few values, with a folder for each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/starloom-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete what stage() wrote and no later step reads."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("starloom-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows in so many parts by their keys, where a number is given. Spark keeps that number, while it joins parts of
    its own as long as they are small when compressed, whatever they take in memory."""
    return df.repartition(parts, *keys) if parts else df


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the row's place from 1 in a total order. Rows are sorted by range, so that no task sees them all; a place
    is the place in the task plus the rows of the tasks before."""
    placed = stage(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_at", "_part", "_row", "_before")
