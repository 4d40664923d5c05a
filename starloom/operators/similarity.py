"""Similarity edges between artists from credit-keyed relations, and the prominence that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(relations: DataFrame, credits: DataFrame, least: float = 0.0) -> DataFrame:
    """Each relation (id_0, id_1, score) with its outcome: malformed, weak, unknown, self or kept, tested in this
    order, and both artists. A credit names one artist, so neither join adds rows."""
    one = credits.select(F.col("id").alias("id_0"), F.col("artist_id").alias("a"))
    other = credits.select(F.col("id").alias("id_1"), F.col("artist_id").alias("b"))
    rows = relations.join(one, "id_0", "left").join(other, "id_1", "left")
    outcome = (
        F.when(F.col("id_0").isNull() | F.col("id_1").isNull() | F.col("score").isNull(), "malformed")
        .when(F.col("score") < F.lit(least).cast("float"), "weak")
        .when(F.col("a").isNull() | F.col("b").isNull(), "unknown")
        .when(F.col("a") == F.col("b"), "self")
        .otherwise("kept")
    )
    return rows.withColumn("outcome", outcome)


def edges(relations: DataFrame, credits: DataFrame, least: float = 0.0) -> DataFrame:
    """(source_id, target_id, score): one row for each unordered pair, its best score. Weak relations go before the
    joins, so that the filter reaches the scan."""
    strong = relations.where(F.col("score") >= F.lit(least).cast("float"))
    kept = judged(strong, credits, least).where("outcome = 'kept'")
    return collapsed(kept.select("a", "b", "score"))


def collapsed(pairs: DataFrame, best: Column | None = None) -> DataFrame:
    """Pairs (a, b, score) in canonical order, one for each, with the greatest score."""
    ends = pairs.where("a <> b").select(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"), "score")
    return ends.groupBy("source_id", "target_id").agg((F.max("score") if best is None else best).alias("score"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(artist_id, other_id, score): each edge from either end; an edge of n rows gives 2 n."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("artist_id"), F.col("target_id").alias("other_id")), F.struct(F.col("target_id").alias("artist_id"), F.col("source_id").alias("other_id"))))
    return edges.select(ends.alias("e"), "score").select("e.*", "score")


def prominence(edges: DataFrame) -> DataFrame:
    """(artist_id, degree, weight): the number of an artist's edges and the sum of their scores."""
    return both_ways(edges).groupBy("artist_id").agg(F.count(F.lit(1)).cast("int").alias("degree"), F.sum(F.col("score").cast("double")).alias("weight"))
