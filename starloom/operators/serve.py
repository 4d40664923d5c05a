"""Answers about artists: cards, neighbours and name search, for one artist or for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import both_ways

GENRES, NEIGHBOURS, HITS = 8, 10, 12
SHORTEST_TERM = 2  # bytes


def newest(positions: DataFrame, layouts: DataFrame) -> DataFrame:
    """(artist_id, x, y, metric_id) in the newest layout that has the artist; layouts(id, metric_id, created_at)."""
    rows = positions.join(layouts.select(F.col("id").alias("layout_id"), "metric_id", "created_at"), "layout_id")
    best = F.max_by(F.struct("x", "y", "metric_id"), F.struct("created_at", "layout_id"))
    return rows.groupBy("artist_id").agg(best.alias("p")).select("artist_id", "p.*")


def top(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank. Spark keeps k rows per key and task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def top_genres(artist_genres: DataFrame, genres: DataFrame, k: int = GENRES) -> DataFrame:
    rows = artist_genres.join(genres.select(F.col("id").alias("genre_id"), "name", "is_style"), "genre_id")
    return top(rows, "artist_id", [F.desc_nulls_last("releases"), F.asc("name"), F.asc("is_style")], k)


def top_neighbours(edges: DataFrame, artists: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(artist_id, rank, other_id, name, score). Edges are read from both ends instead of by an OR of two columns."""
    names = artists.select(F.col("id").alias("other_id"), "name")
    return top(both_ways(edges), "artist_id", [F.desc_nulls_last("score"), F.asc("other_id")], k).join(names, "other_id")


def best_neighbours(edges: DataFrame, artist_id: int, k: int = NEIGHBOURS) -> DataFrame:
    """(artist_id, rank, other_id, score) of one artist's best k edges, at either end of them."""
    other = F.when(F.col("source_id") == artist_id, F.col("target_id")).otherwise(F.col("source_id"))
    rows = edges.select(F.lit(artist_id).cast("int").alias("artist_id"), other.alias("other_id"), "score")
    return top(rows, "artist_id", [F.desc_nulls_last("score"), F.asc("other_id")], k).select("artist_id", "rank", "other_id", "score")


def cards(artists: DataFrame, positions: DataFrame, prominence: DataFrame, genres: DataFrame, neighbours: DataFrame) -> DataFrame:
    """A row per artist with nested position, genres and neighbours, as a service returns it. genres and neighbours
    are the results of top_genres() and top_neighbours(). Filter `artists` for a single card; none gives no row."""
    place = positions.join(prominence.select("artist_id", "weight"), "artist_id", "left")
    place = place.select(F.col("artist_id").alias("id"), F.struct("x", "y", F.coalesce("weight", F.lit(0.0)).alias("brightness")).alias("position"))
    listed = lambda df, *cols: df.groupBy(F.col("artist_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("l"))
    tags = listed(genres, "name", "is_style", "releases").withColumnRenamed("l", "genres")
    near = listed(neighbours, "other_id", "name", "score").withColumnRenamed("l", "similar")
    return artists.join(place, "id", "left").join(tags, "id", "left").join(near, "id", "left")


def search(artists: DataFrame, positions: DataFrame, prominence: DataFrame, term: str, hits: int = HITS) -> DataFrame:
    """Placed artists whose name contains the term (% and _ are wildcards): exact names first, then by weight, by
    prefix, by length, by name. A term under two bytes finds nothing."""
    term = term.strip()
    found = artists if len(term.encode()) >= SHORTEST_TERM else artists.where(F.lit(False))
    rows = found.where(F.col("name").ilike(f"%{term}%")).join(positions.select(F.col("artist_id").alias("id"), "x", "y"), "id")
    rows = rows.join(prominence.select(F.col("artist_id").alias("id"), "weight"), "id", "left")
    order = [F.desc(F.lower("name") == term.lower()), F.desc(F.coalesce("weight", F.lit(0.0))), F.desc(F.col("name").ilike(f"{term}%")), F.length("name"), F.col("name"), F.col("id")]
    return rows.orderBy(*order).limit(hits)
