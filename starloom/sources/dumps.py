"""Dump files as DataFrames: COPY TEXT, JSON lines, JSON arrays by line, XML records and index lines.

Compressed text is read by Spark itself (bzip2 splits, gzip doesn't); tar archives by the source in archives.py, wanted
streams of a multi-stream archive by streams.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import XML_NAMES, copy_fields, decoded, whole_number
from ..operators.facts import entities
from . import archives

#: COPY TEXT tables: (name, position, type) of the columns in use (fixed values).
COPY_COLUMNS: dict[str, list[tuple[str, int, str]]] = {
    "artist": [("id", 0, "int"), ("mbid", 1, "uuid"), ("name", 2, "string"), ("sort_name", 3, "string"), ("begin_year", 4, "smallint"), ("end_year", 7, "smallint"), ("kind_id", 10, "int"), ("area_id", 11, "int"), ("comment", 13, "string"), ("ended", 16, "flag")],
    "artist_type": [("id", 0, "int"), ("name", 1, "string")],
    "release_group_primary_type": [("id", 0, "int"), ("name", 1, "string")],
    "area": [("id", 0, "int"), ("name", 2, "string")],
    "iso_3166_1": [("id", 0, "int"), ("name", 1, "string")],
    "release": [("release", 0, "int"), ("group", 4, "int")],
    "release_country": [("release", 0, "int"), ("year", 2, "smallint")],
    "release_unknown_country": [("release", 0, "int"), ("year", 1, "smallint")],
    "release_group": [("id", 0, "int"), ("mbid", 1, "uuid"), ("name", 2, "string"), ("credit", 3, "int"), ("kind_id", 4, "int")],
    "artist_credit_name": [("credit", 0, "int"), ("position", 1, "int"), ("artist", 2, "int")],
    "url": [("id", 0, "int"), ("url", 2, "string")],
    "link": [("id", 0, "int"), ("kind_id", 1, "int")],
    "link_type": [("id", 0, "int"), ("from", 4, "string"), ("to", 5, "string"), ("name", 6, "string")],
    "l_artist_url": [("link", 1, "int"), ("artist_id", 2, "int"), ("url_id", 3, "int")],
}

#: What a record of each kind begins with. A record of labels or artists has no attributes, records of the same name inside
#: others have (fixed values of the dumps).
RECORD_START = {"master": "<master", "label": "<label>", "artist": "<artist>", "page": "<page>"}
#: What a file begins with; and elements inside a record that have an id, a name or a label of others (fixed values).
HEADER = r"\A\s*\ufeff?\s*(?:\z|<(?:\?xml|!DOCTYPE|masters|labels|artists|mediawiki)\b)"
OTHERS = "members|aliases|groups|namevariations|sublabels|images|urls"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of text files; of a tar archive, those of the members that hold relations."""
    if archives.is_tar(path):
        return archives.lines(spark, path, ["*relations.json"]).select("value")
    return spark.read.option("lineSep", "\n").text(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: the file, where their block begins in it, and their number among the lines of their task.
    Every scan of the same files is cut alike."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


#: Files whose ends are compared in each task; with more the ends are joined.
MOST_ENDS = 1000


def copy_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of COPY TEXT files up to each file's end mark, a lone \\. in its line. The ends are one row a file,
    found by a scan for that line alone; lines aren't shuffled."""
    rows = _placed(spark, path)
    ends = rows.where(F.rtrim(F.col("value")).isin("\\.", "\\.\r")).groupBy("file").agg(F.min(F.struct("block", "line")).alias("end"))
    first = ends.limit(MOST_ENDS + 1).collect()
    if len(first) > MOST_ENDS:
        return rows.join(ends, "file", "left").where(F.col("end").isNull() | (F.struct("block", "line") < F.col("end"))).select("value")
    for r in first:
        rows = rows.where((F.col("file") != r.file) | (F.col("block") < r.end.block) | ((F.col("block") == r.end.block) & (F.col("line") < r.end.line)))
    return rows.select("value")


def first_lines(spark: SparkSession, path: str, limit: int, wanted: Callable[[Column], Column]) -> DataFrame:
    """The first `limit` wanted lines (value) in the order of files and of places in them, the same each time. Lines are
    counted by block; then the blocks before the one that reaches the limit are read whole, and of that one the first."""
    rows = _placed(spark, path).where(wanted(F.col("value")))
    left, cut = limit, None
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).sort("file", "block")
    for r in counts.toLocalIterator():
        if r.n >= left:
            cut = r
            break
        left -= r.n
    if cut is None:
        return rows.select("value")
    before = rows.where((F.col("file") < cut.file) | ((F.col("file") == cut.file) & (F.col("block") < cut.block)))
    own = rows.where((F.col("file") == cut.file) & (F.col("block") == cut.block))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("line"))).where(F.col("place") <= left)
    return before.select("value").unionByName(own.select("value"))


def copy_table(rows: DataFrame, table: str) -> DataFrame:
    """Typed columns of COPY TEXT lines (value); what is malformed is null. An end mark, alone in its line, goes;
    copy_lines() also leaves out what follows it."""
    fields = rows.where(~F.col("value").isin("\\.", "\\.\r")).select(copy_fields(F.try_validate_utf8("value")).alias("f"))

    def typed(at: int, kind: str):
        field = F.get(F.col("f"), F.lit(at))
        if kind == "string":
            return field
        if kind == "flag":
            return F.coalesce(field == "t", F.lit(False))
        if kind == "uuid":
            return F.when(field.rlike(r"(?i)\A[0-9a-f]{8}(-?[0-9a-f]{4}){3}-?[0-9a-f]{12}\z"), F.lower(field))
        return whole_number(field, kind)

    return fields.select(*(typed(at, kind).alias(name) for name, at, kind in COPY_COLUMNS[table]))


def relations(rows: DataFrame) -> DataFrame:
    """(id_0, id_1, score) of JSON lines; blank and malformed lines, and those without all three, go."""
    parsed = rows.select(F.from_json("value", "id_0 int, id_1 int, score float").alias("r")).select("r.*")
    return parsed.where("id_0 is not null and id_1 is not null and score is not null")


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    return entities(lines(spark, path))


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records (value) of XML files, each from behind its opening tag's name to its end, or to where the file is cut.

    A file is cut where records begin, so compressed files that can be split are, and whatever is wrong in a record (a
    cut end, an unknown entity, a stray ampersand) touches that record alone. A file that can't be split is one task, so records of few files are dealt out again.
    """
    rows = spark.read.option("lineSep", RECORD_START[kind]).text(path).where(~F.col("value").rlike(HEADER))
    value = F.regexp_replace("value", "(?s)<!--.*?(?:-->|\\z)", "")
    if kind in ("label", "artist"):
        value = F.regexp_replace(F.regexp_replace(value, f"<(?:{OTHERS})(?:\\s[^<>]*)?/>", ""), f"(?s)<({OTHERS})(?:\\s[^<>]*)?>.*?(?:</\\1>|\\z)", "")
    elif kind == "master":
        rows = rows.where(F.col("value").rlike(r"\A(?:\s|/?>)"))
    rows = rows.select(F.substring_index(value, f"</{kind}>", 1).alias("value"))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def xml_text(raw: Column) -> Column:
    """What an element's content says: references to characters decoded, marked character data as it is, blanks trimmed."""
    piece = lambda x: F.when(F.startswith(x, F.lit("<![CDATA[")), F.regexp_replace(x, r"\A<!\[CDATA\[|\]\]>\z", "")).otherwise(decoded(x, XML_NAMES))
    pieces = F.regexp_extract_all(raw, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|[^<]+"), F.lit(0))
    whole = F.when(F.contains(raw, F.lit("<![CDATA[")), F.array_join(F.transform(pieces, piece), "")).otherwise(decoded(raw, XML_NAMES))
    return F.regexp_replace(whole, r"\A\s+|\s+\z", "")


_CONTENT = r"((?:[^<]|<!\[CDATA\[(?s:.*?)\]\]>)*)"


def elements(body: Column, name: str) -> Column:
    """array<string>: the contents of all closed elements of a name that hold text."""
    return F.transform(F.regexp_extract_all(body, F.lit(f"<{name}(?:\\s[^<>]*)?>{_CONTENT}</{name}>"), F.lit(1)), xml_text)


def inside(body: Column, name: str) -> Column:
    """What stands in the first element of a name, or from it to the end of a cut record; empty if there is none."""
    return F.regexp_extract(body, f"(?s)<{name}(?:\\s[^<>]*)?(?<!/)>(.*?)(?:</{name}>|\\z)", 1)


def masters(rows: DataFrame) -> DataFrame:
    """(artists, genres, styles) arrays of master records, as operators.genres.tagged() takes them."""
    value = F.col("value")
    ids = F.filter(F.transform(elements(inside(value, "artists"), "id"), lambda a: whole_number(a)), lambda a: a.isNotNull())
    full = lambda c: F.filter(c, lambda g: g != "")
    return rows.select(ids.alias("artists"), full(elements(inside(value, "genres"), "genre")).alias("genres"), full(elements(inside(value, "styles"), "style")).alias("styles"))


def labels(rows: DataFrame) -> DataFrame:
    value = F.col("value")
    first = lambda name: F.get(elements(value, name), F.lit(0))
    parent = F.nullif(F.regexp_extract(value, r"""<parentLabel\s(?:[^<>]*\s)?id=["']([^"'<>]*)["']""", 1), F.lit(""))
    return rows.select(whole_number(first("id")).alias("id"), first("name").alias("name"), first("profile").alias("profile"), whole_number(parent).alias("parent_id"))


def artist_ids(rows: DataFrame) -> DataFrame:
    """(artist) of artist records; nested elements' ids have gone."""
    return rows.select(whole_number(F.get(elements(F.col("value"), "id"), F.lit(0))).alias("artist"))


def pages(rows: DataFrame) -> DataFrame:
    """(title, revision_id, text) of page records, the dump's own escapes undone; a page cut before its text ended goes."""
    value = F.col("value")
    revision = F.get(F.split(value, "<revision>", 2), F.lit(1))
    body = F.get(F.split(F.get(F.split(revision, "<text(?=[\\s>])", 2), F.lit(1)), ">", 2), F.lit(1))
    text = F.when(F.contains(body, F.lit("</text>")), decoded(F.substring_index(body, "</text>", 1), XML_NAMES))
    number = whole_number(F.get(elements(revision, "id"), F.lit(0)), "bigint")
    return rows.select(F.get(elements(value, "title"), F.lit(0)).alias("title"), number.alias("revision_id"), text.alias("text")).where("title is not null and text is not null")


def index(rows: DataFrame) -> DataFrame:
    """(offset, page_id, title) of index lines; a title may hold colons."""
    parts = F.split("value", ":", 3)
    return rows.select(F.get(parts, F.lit(0)).try_cast("bigint").alias("offset"), F.get(parts, F.lit(1)).try_cast("bigint").alias("page_id"), F.get(parts, F.lit(2)).alias("title")).where("offset is not null and title is not null")


def wanted_streams(index: DataFrame, titles: DataFrame) -> DataFrame:
    """(offset, titles): the streams that hold wanted pages, each with all it is wanted for."""
    found = index.join(titles.select("title").distinct(), "title", "left_semi")
    return found.groupBy("offset").agg(F.sort_array(F.collect_set("title")).alias("titles"))
