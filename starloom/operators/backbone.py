"""The canon's backbone: artists, release groups with years, credits and urls, joined from dump tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dealt


def named(df: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """Add names(id, name) by `key`; rows without one keep null. Small name tables are broadcast by the optimizer."""
    return df.join(names.select(F.col("id").alias(key), F.col("name").alias(out)), key, "left")


def artists(rows: DataFrame, kinds: DataFrame, areas: DataFrame, codes: DataFrame) -> DataFrame:
    """rows(id, mbid, name, sort_name, kind_id, area_id, begin_year, end_year, ended, comment); codes(id, name)."""
    rows = rows.where("id is not null and mbid is not null and name is not null and sort_name is not null")
    rows = named(named(named(rows, kinds, "kind_id", "kind"), areas, "area_id", "area"), codes, "area_id", "area_code")
    return rows.withColumn("comment", F.nullif("comment", F.lit(""))).drop("kind_id", "area_id")


def first_credits(names: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, artist_id): the artist in first position of each credit, if known."""
    first = names.where("position = 0").select(F.col("credit").alias("id"), F.col("artist").alias("artist_id"))
    return first.join(artists.select(F.col("id").alias("artist_id")), "artist_id", "left_semi").select("id", "artist_id")


def group_years(dates: list[DataFrame], releases: DataFrame, parts: int | None = None) -> DataFrame:
    """(group, year): the earliest year of a release group's releases. dates: (release, year); releases: (release,
    group). A release without a group counts nowhere. parts: as for dealt()."""
    dated = dates[0]
    for d in dates[1:]:
        dated = dated.unionByName(d)
    dated = dealt(dated.where("year is not null"), parts, "release").groupBy("release").agg(F.min("year").alias("year"))
    grouped = dated.join(dealt(releases, parts, "release"), "release").select("group", "year")
    return dealt(grouped, parts, "group").groupBy("group").agg(F.min("year").alias("year"))


def release_groups(groups: DataFrame, credits: DataFrame, kinds: DataFrame, years: DataFrame, parts: int | None = None) -> DataFrame:
    """groups(id, mbid, name, credit, kind_id) whose credit is known, with kind and year where there are any. parts: as
    for dealt()."""
    rows = dealt(groups, parts, "credit").join(dealt(credits.select(F.col("id").alias("credit"), "artist_id"), parts, "credit"), "credit")
    rows = named(rows, kinds, "kind_id", "primary_type")
    rows = dealt(rows, parts, "id").join(years.select(F.col("group").alias("id"), "year"), "id", "left")
    return rows.select("id", "mbid", "name", "primary_type", "artist_id", "year")


def artist_urls(links: DataFrame, link: DataFrame, kinds: DataFrame, urls: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, kind, url), each once. links(link, artist_id, url_id), link(id, kind_id), kinds(id, from, to, name)."""
    wanted = kinds.where("`from` = 'artist' and `to` = 'url'").select(F.col("id").alias("kind_id"), F.col("name").alias("kind"))
    rows = links.join(link.select(F.col("id").alias("link"), "kind_id"), "link").join(wanted, "kind_id")
    rows = rows.join(urls.select(F.col("id").alias("url_id"), "url"), "url_id")
    rows = rows.join(artists.select(F.col("id").alias("artist_id")), "artist_id", "left_semi")
    return rows.select("artist_id", "kind", "url").dropDuplicates()
