"""Genre vocabulary and counts from master records, and label parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dealt, stage

MOST_OF_A_NAME = 10_000  # artists of one name that go to every task

def tagged(masters: DataFrame) -> DataFrame:
    """(artist, name, is_style): masters(artists array, genres array, styles array) by every credited artist and every
    tag; repeated ones count again. Masters without a tag go."""
    tags = F.concat(
        F.transform(F.coalesce("genres", F.array().cast("array<string>")), lambda g: F.named_struct(F.lit("name"), g, F.lit("is_style"), F.lit(False))),
        F.transform(F.coalesce("styles", F.array().cast("array<string>")), lambda g: F.named_struct(F.lit("name"), g, F.lit("is_style"), F.lit(True))),
    )
    rows = masters.where("size(genres) > 0 or size(styles) > 0").select(F.explode("artists").alias("artist"), tags.alias("tags"))
    return rows.select("artist", F.explode("tags").alias("t")).select("artist", "t.name", "t.is_style").where("name <> ''")


def counts(tags: DataFrame, wanted: DataFrame, known: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(artist, name, is_style, releases) of the wanted artists (and, where given, known ones). parts: as for dealt(); an
    artist's tags are then counted where they meet the wanted ones."""
    tags = dealt(tags, parts, "artist").join(dealt(wanted.select("artist"), parts, "artist"), "artist", "left_semi")
    if known is not None:
        tags = tags.join(dealt(known.select("artist"), parts, "artist"), "artist", "left_semi")
    return tags.groupBy("artist", "name", "is_style").agg(F.count(F.lit(1)).alias("releases"))


def vocabulary(tags: DataFrame) -> DataFrame:
    """(id, name, is_style): distinct tags, numbered in their order. The number is a tag's rank among all, found by
    counting those before its first letter's group and within it, so that no task numbers the whole vocabulary."""
    from pyspark.sql import Window

    words = stage(tags.select("name", "is_style").distinct().withColumn("part", F.substring("name", 1, 1)), "words")  # read twice, and all tags else
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("name", "is_style")))
    return ranked.join(before, "part").select((F.col("before") + F.col("rank")).cast("int").alias("id"), "name", "is_style")


def summed(counts: DataFrame, mapping: DataFrame, vocabulary: DataFrame, parts: int | None = None) -> DataFrame:
    """(artist_id, genre_id, releases): counts of all entries that map to an artist, added up. parts: as in counts()."""
    rows = counts.join(dealt(mapping, parts, "artist"), "artist").join(vocabulary, ["name", "is_style"])
    return rows.groupBy("artist_id", F.col("id").alias("genre_id")).agg(F.sum("releases").alias("releases"))


def with_parents(labels: DataFrame) -> DataFrame:
    """labels(id, name, profile, parent_id) with a parent only where it exists and is another label."""
    labels = labels.where("id is not null and name is not null")
    there = labels.select(F.col("id").alias("parent_id"), F.col("id").alias("parent_label_id"))
    rows = labels.join(there, "parent_id", "left")
    return rows.select("id", "name", F.nullif("profile", F.lit("")).alias("profile"), F.when(F.col("parent_label_id") != F.col("id"), F.col("parent_label_id")).alias("parent_label_id"))


def of_name(artist_genres: DataFrame, words: DataFrame, artists: DataFrame, name: str) -> DataFrame:
    """(id, genre, is_style, releases) of every artist of exactly this name. Artists are narrowed first."""
    found = artists.where(F.col("name") == name).select(F.col("id").alias("artist_id"))
    rows = artist_genres.join(F.broadcast(found) if found.limit(MOST_OF_A_NAME + 1).count() <= MOST_OF_A_NAME else found, "artist_id")
    return rows.join(words.select(F.col("id").alias("genre_id"), F.col("name").alias("genre"), "is_style"), "genre_id").select(F.col("artist_id").alias("id"), "genre", "is_style", "releases")


def entries(artist_discogs: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, name, discogs_id): the catalogue's entry of each artist that has one."""
    return artist_discogs.join(artists.select(F.col("id").alias("artist_id"), "name"), "artist_id").select(F.col("artist_id").alias("id"), "name", "discogs_id")
