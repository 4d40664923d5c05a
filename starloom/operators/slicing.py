"""A smaller canon: the brightest artists and all that refers to them, kept consistent; and the check of that."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHECKS, FK_TO_ARTIST, TABLES

KEEP = 100_000


def kept(positions: DataFrame, prominence: DataFrame, keep: int = KEEP) -> DataFrame:
    """(artist_id) of the `keep` placed artists of greatest weight, ties by id."""
    if keep < 1:
        raise ValueError("a slice keeps one artist at least")
    rows = positions.select("artist_id").distinct().join(prominence.select("artist_id", "weight"), "artist_id", "left")
    return rows.orderBy(F.coalesce("weight", F.lit(0.0)).desc_nulls_last(), "artist_id").limit(keep).select("artist_id")


def pruned(table: DataFrame, columns: list[str], kept: DataFrame) -> DataFrame:
    """Rows whose every reference is kept or null (a row without an artist isn't removed with one). The table is read
    once, whatever the number of references. Rows without one go to any task: they take negative numbers, which no artist has."""
    known = kept.select(F.col("artist_id").cast("bigint").alias("_kept")).distinct()
    out = table
    for c in columns:
        spread = -1 - F.pmod(F.xxhash64(*table.columns), F.lit(1 << 20))
        out = out.withColumn("_key", F.coalesce(F.col(c).cast("bigint"), spread)).join(known, F.col("_key") == F.col("_kept"), "left")
        out = out.where(F.col(c).isNull() | F.col("_kept").isNotNull()).drop("_key", "_kept")
    return out


#: Names that may stand in a query without quotes: small letters, digits and underscores, at most 63.
_PLAIN = re.compile("[a-z][a-z0-9_]{0,62}")


def is_plain_identifier(name: str) -> bool:
    return _PLAIN.fullmatch(name) is not None


def cut(canon: dict[str, DataFrame], kept: DataFrame) -> dict[str, DataFrame]:
    """The canon's tables after a slice; labels, which no artist refers to, are emptied."""
    if odd := [name for name in canon if not is_plain_identifier(name)]:
        raise ValueError(f"no table names: {odd}")
    out = dict(canon)
    for name in {t for t, _ in FK_TO_ARTIST} & canon.keys():
        out[name] = pruned(canon[name], [c for t, c in FK_TO_ARTIST if t == name], kept)
    out["artist"] = canon["artist"].join(kept.select(F.col("artist_id").alias("id")), "id", "left_semi").select(canon["artist"].columns)
    if "label" in canon:
        out["label"] = canon["label"].where(F.lit(False))
    return out


def faults(canon: dict[str, DataFrame]) -> DataFrame:
    """(table, fault, rows): dangling references, repeated keys and broken conditions; no rows if all is well."""
    spark = canon["artist"].sparkSession
    found = spark.createDataFrame([], "`table` string, fault string, rows bigint")
    note = lambda df, t, what: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), F.lit(what).alias("fault"), "rows")
    ids = canon["artist"].select("id")
    for t, c in FK_TO_ARTIST:
        if t in canon:
            found = found.unionByName(note(canon[t].where(F.col(c).isNotNull()).join(ids.withColumnRenamed("id", c), c, "left_anti"), t, f"dangling {c}"))
    for t, df in canon.items():
        key = TABLES[t][1]
        found = found.unionByName(note(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), t, "repeated key"))
        if t in CHECKS:
            found = found.unionByName(note(df.where(f"NOT ({CHECKS[t]})"), t, CHECKS[t]))
    return found.where("rows > 0")
