"""Prose for artists: the lead of the encyclopedia page that an artist's facts name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import lead
from ..functions.parsing import page_url

LICENCE, BASE_URL = "CC BY-SA 4.0", "https://en.wikipedia.org/wiki/"


def wanted(titles: DataFrame) -> DataFrame:
    """(title, artist_id): pages that artists name; of several artists the least takes a page."""
    return titles.where("enwiki_title is not null").groupBy(F.col("enwiki_title").alias("title")).agg(F.min("artist_id").alias("artist_id"))


def prose(pages: DataFrame, titles: DataFrame, version: str) -> DataFrame:
    """pages(title, revision_id, text) that are wanted and have a lead, with attribution and sizes in code points. The
    join comes first, so only wanted pages' markup is worked on."""
    rows = pages.join(wanted(titles), "title").withColumn("extract", lead(F.col("text"))).where("extract is not null")
    return rows.select(
        "artist_id",
        "extract",
        F.col("title").alias("source_title"),
        page_url(F.col("title"), BASE_URL).alias("source_url"),
        F.lit(LICENCE).alias("licence"),
        F.lit(version).alias("dump_version"),
        "revision_id",
        F.length("text").alias("source_chars"),
        F.length("extract").alias("extract_chars"),
    )


def attribution(prose: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, name, source_title, source_url, licence, dump_version, share): what has to stand beside each extract, and how
    many per cent of its page the extract is (null for an empty page)."""
    share = F.round(F.lit(100.0) * F.col("extract_chars") / F.nullif("source_chars", F.lit(0)), 1)
    rows = prose.join(artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    return rows.select(F.col("artist_id").alias("id"), "name", "source_title", "source_url", "licence", "dump_version", share.alias("share"))


def coverage(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """One row: wanted titles, pages found and pages without a lead."""
    rows = wanted(titles).join(pages, "title", "left").select(F.col("text").isNotNull().alias("found"), (F.col("text").isNotNull() & lead(F.col("text")).isNull()).alias("bare"))
    return rows.agg(F.count(F.lit(1)).alias("wanted"), F.count_if("found").alias("found"), F.count_if("bare").alias("without_lead"))
