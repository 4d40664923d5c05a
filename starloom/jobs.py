"""Whole jobs over a canon: imports, layout, tiles, slice, card and search, as the command line runs them."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import progress
from .functions import parsing
from .operators import backbone, facts, genres, layout, prose, serve, similarity, slicing, tiles
from .schema import FK_TO_ARTIST, PARTS, TABLES
from .sources import archives, dumps, streams, tilefiles
from .staging import stage
from .store import LEDGER, Canon, Snapshot, numbered


def typed(df: DataFrame, table: str) -> DataFrame:
    """Columns of a canon table in its order and types; missing ones are null."""
    columns = [c.rsplit(" ", 1) for c in TABLES[table][0].split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns))


def _all(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _got(observed: Observation, rows: DataFrame, *counts: Column) -> dict[str, int]:
    """What was observed of the rows; where Spark has left the step out of the plan, as it does where a join has an empty
    side, they are counted by themselves."""
    try:
        return observed.get
    except Py4JJavaError:
        return rows.agg(*counts).first().asDict()


def require(canon: Canon | Snapshot, table: str, before: str) -> None:
    if canon.read(table).isEmpty():
        raise ValueError(f"import {before} first: {table} is empty")


class _Made:
    """A step's outcome, made again only when one of the tables that it reads has changed."""

    def __init__(self, make: Callable[[Snapshot], DataFrame], *inputs: tuple):
        self._make, self._inputs, self._of = make, inputs, None

    def at(self, at: Snapshot) -> DataFrame:
        now = [at.folders(*i) for i in self._inputs]
        if now != self._of:
            self._rows, self._of = self._make(at), now
        return self._rows


def _copy_tables(canon: Canon, path: str) -> dict[str, DataFrame]:
    """COPY TEXT tables: a file or folder each in a folder, or members of a tar archive, which is read once and landed."""
    if archives.is_tar(path):
        name = F.substring_index("member", "/", -1)
        rows = stage(archives.lines(canon.spark, path, [f"*mbdump/{t}" for t in dumps.COPY_COLUMNS], end_mark=True).select(name.alias("table"), "value"), "archive", by="table")
        return {t: dumps.copy_table(rows.where(F.col("table") == t), t) for t in dumps.COPY_COLUMNS}
    return {t: dumps.copy_table(dumps.copy_lines(canon.spark, f"{path}/{t}"), t) for t in dumps.COPY_COLUMNS}


def import_backbone(canon: Canon, path: str, version: str) -> int:
    """COPY TEXT tables in a folder or a tar archive. Empties all tables that refer to artists."""
    t = _copy_tables(canon, path)
    artists = stage(typed(backbone.artists(t["artist"], t["artist_type"], t["area"], t["iso_3166_1"]), "artist"), "artists")
    if artists.isEmpty():
        raise ValueError(f"no artists in {path}")
    read = Observation("groups read")
    credits = stage(typed(backbone.first_credits(t["artist_credit_name"], artists), "artist_credit"), "credits")
    years = backbone.group_years([t["release_country"], t["release_unknown_country"]], t["release"])
    counted = t["release_group"].observe(read, _all("release_groups")).where("id is not null and mbid is not null and name is not null")
    groups = stage(typed(backbone.release_groups(counted, credits, t["release_group_primary_type"], years), "release_group"), "groups")
    urls = backbone.artist_urls(t["l_artist_url"], t["link"], t["link_type"], t["url"], artists)
    tables = {"artist": artists, "artist_credit": credits, "release_group": groups, "artist_url": typed(urls, "artist_url")}
    rows = canon.replace(tables, "backbone", version, emptied=["*"])
    canon.counters = _got(read, t["release_group"], _all("release_groups")) | {"kept": groups.count()}
    return rows


def import_similarity(canon: Canon, path: str, version: str, least: float = 0.0, metric: str = "relations") -> int:
    """JSON lines of credit-keyed relations; replaces one metric's edges and prominence and leaves the others' where they
    are."""

    def edges(at: Snapshot) -> DataFrame:
        require(at, "artist_credit", "the backbone")
        seen, outcome = Observation("relations"), Observation("outcomes")
        weak = F.col("score") < F.lit(least).cast("float")
        relations = dumps.relations(dumps.lines(canon.spark, path))
        all_, each = [_all("relations"), F.count_if(weak).alias("weak")], [F.count_if(F.col("outcome") == o).alias(o) for o in ("unknown", "self", "kept")]
        plain = similarity.judged(relations.where(~weak), at.read("artist_credit"), least)
        judged = similarity.judged(relations.observe(seen, *all_).where(~weak), at.read("artist_credit"), least).observe(outcome, *each)
        rows = stage(similarity.collapsed(judged.where("outcome = 'kept'").select("a", "b", "score")), "edges")
        canon.counters = _got(seen, relations, *all_) | _got(outcome, plain, *each)
        return rows

    found = _Made(edges, ("artist_credit",))

    def build(at: Snapshot) -> dict:
        rows, known = found.at(at), at.read("similarity_metric")
        ids = numbered(known.select("id", "key"), canon.spark.createDataFrame([(metric,)], "key string"), "key")
        number = ids.where(F.col("key") == metric).first().id
        about = "similarity from relations" + (f", score of {least} or more" if least > 0 else "")
        mine = lambda df, name: typed(df.withColumn("metric_id", F.lit(number)), name)
        return {
            "similarity_metric": known.where(F.col("key") != metric).unionByName(typed(canon.spark.createDataFrame([(number, metric, about)], "id int, key string, description string"), "similarity_metric")),
            ("artist_similarity", number): mine(rows, "artist_similarity"),
            ("artist_prominence", number): mine(similarity.prominence(rows), "artist_prominence"),
        }

    return canon.update(f"similarity {metric}", version, build)


def import_genres(canon: Canon, masters: str, version: str, labels: str | None = None, artists: str | None = None) -> int:
    """Master records, and label and artist records where given; artists are matched by their catalogue urls."""

    def build(at: Snapshot) -> dict:
        require(at, "artist_url", "the backbone")
        links = at.read("artist_url").where("kind = 'discogs'").select("artist_id", parsing.id_after(F.col("url"), "/artist/").alias("artist")).where("artist is not null")
        mapping = stage(links.distinct(), "mapping")
        known = dumps.artist_ids(dumps.records(canon.spark, artists, "artist")) if artists else None
        tags = genres.tagged(dumps.masters(dumps.records(canon.spark, masters, "master")))
        seen = Observation("tags")
        counted = stage(genres.counts(tags.observe(seen, _all("tags")), mapping, known), "counts")
        canon.counters = _got(seen, tags, _all("tags")) | counted.agg(F.coalesce(F.sum("releases"), F.lit(0)).alias("credited")).first().asDict()
        words = stage(genres.vocabulary(counted), "vocabulary")
        entry = mapping.groupBy("artist_id").agg(F.min("artist").alias("discogs_id"))
        tables = {"genre": typed(words, "genre"), "artist_genre": typed(genres.summed(counted, mapping, words), "artist_genre"), "artist_discogs": typed(entry, "artist_discogs")}
        if labels:
            tables["label"] = typed(genres.with_parents(dumps.labels(dumps.records(canon.spark, labels, "label"))), "label")
        return tables

    return canon.update("genres", version, build)


def import_facts(canon: Canon, path: str, version: str = "latest", limit: int | None = None, tell: Callable[[int, int], None] | None = None) -> int:
    """Entity records, one to a line; replaces the six tables of facts. limit: the first so many entities of the dump;
    tell: called with the tasks done and the tasks known, while the dump is read."""

    def build(at: Snapshot) -> dict:
        require(at, "artist", "the backbone")
        rows = dumps.entity_lines(canon.spark, path) if limit is None else facts.entities(dumps.first_lines(canon.spark, path, limit, facts.is_entity))
        with progress.told(canon.spark, tell):
            found = stage(facts.slim(rows), "entities")
        rows = stage(facts.facts(found, at.read("artist").select("id", "mbid")), "facts")
        canon.counters = facts.counted(found, rows).first().asDict()
        many = lambda c, out: rows.select("artist_id", F.explode(c).alias(out)).distinct()
        tables = {
            "artist_wikidata": rows,
            "artist_fact": rows,
            "artist_wikidata_genre": many("genres", "genre_qid"),
            "artist_wikidata_label": many("labels", "label_qid"),
            "artist_influence": facts.influences(rows),
            "wikidata_item": facts.referenced_items(rows, found),
        }
        return {n: typed(df, n) for n, df in tables.items()}

    return canon.update("facts", version, build)


def import_prose(canon: Canon, path: str, version: str, limit: int | None = None, index: str | None = None) -> int:
    """Page records of an encyclopedia dump. With its index only the streams that hold wanted pages are read, each by its
    place in the file; without, concatenated bzip2 streams are split and read in parallel. limit: so many wanted pages at
    most, the first by title."""

    def build(at: Snapshot) -> dict:
        require(at, "artist_wikidata", "facts")
        wanted = prose.wanted(at.read("artist_wikidata")).select("title")
        if index:
            rows = streams.pages(canon.spark, path, dumps.index(dumps.lines(canon.spark, index)), wanted)
        else:
            rows = dumps.pages(dumps.records(canon.spark, path, "page"))
        found = rows.join(wanted, "title", "left_semi")
        found = stage(found if limit is None else found.orderBy("title").limit(limit), "pages")
        canon.counters = prose.coverage(found, at.read("artist_wikidata")).first().asDict()
        rows = stage(typed(prose.prose(found, at.read("artist_wikidata"), version), "artist_prose"), "prose")
        if rows.isEmpty():
            raise ValueError("no wanted page in this dump")
        return {"artist_prose": rows}

    return canon.update("prose", version, build)


def make_layout(canon: Canon, metric: str | None = None, iterations: int = layout.ITERATIONS, seed: int = layout.SEED, least: float = 0.0, reach: int = layout.REACH, tiles_dir: str | None = None) -> str:
    """Lay one metric's graph out and store its positions under a key; the same key replaces the same layout and leaves
    the others' where they are. reach: how fine repulsion is; tiles_dir: where tiles are then written, if anywhere."""
    metrics = canon.read("similarity_metric")
    chosen = (metrics if metric is None else metrics.where(F.col("key") == metric)).limit(2).collect()
    if len(chosen) != 1:
        raise ValueError(f"name one metric of {[m.key for m in metrics.orderBy('id').limit(100).collect()]}")
    number, key = chosen[0].id, f"{chosen[0].key}-fd{iterations}-s{seed}"

    def placed(at: Snapshot) -> DataFrame:
        edges = at.read("artist_similarity", number).where(F.col("score") >= F.lit(least).cast("float")).select("source_id", "target_id", "score")
        return stage(layout.run(edges, iterations, seed, reach), "layout")

    place = _Made(placed, ("artist_similarity", number))

    def build(at: Snapshot) -> dict:
        rows, old = place.at(at), at.read("sky_layout")
        own = numbered(old.select("id", "key"), canon.spark.createDataFrame([(key,)], "key string"), "key").where(F.col("key") == key).first().id
        about = f"force-directed, {iterations} rounds, edges of {least} or more"
        line = canon.spark.range(1).select(F.lit(own).alias("id"), F.lit(key).alias("key"), F.lit(number).alias("metric_id"), F.lit(about).alias("description"), F.lit(seed).alias("seed"), F.current_timestamp().alias("created_at"), F.lit(rows.count()).alias("stars"))
        return {
            "sky_layout": old.where(F.col("key") != key).unionByName(typed(line, "sky_layout")),
            ("artist_position", own): typed(rows.withColumn("layout_id", F.lit(own)), "artist_position"),
        }

    canon.update("layout", key, build)
    if tiles_dir:
        write_tiles(canon, tiles_dir)
    return key


def newest(canon: Canon | Snapshot) -> tuple[DataFrame, DataFrame]:
    """(positions, prominence) of the newest layout and its metric."""
    last = canon.read("sky_layout").orderBy(F.desc("created_at"), F.desc("id")).first()
    if last is None:
        raise ValueError("lay the graph out first: there is no layout")
    return canon.read("artist_position", last.id), canon.read("artist_prominence", last.metric_id)


def write_tiles(canon: Canon, folder: str, level0: int = tiles.LEVEL0_STARS, most: int = tiles.MAX_LEVEL) -> int:
    """Tiles as files level/col/row.bin of a folder, with the sky's square beside them. Older files of other tiles stay."""
    stars = stage(tiles.stars(*newest(canon)), "stars")
    files = stage(tiles.files(stage(tiles.pyramid(stars, level0, most), "pyramid")), "tiles")
    tilefiles.write(files, f"{folder}/tiles")
    deepest = files.select(F.max(F.split("path", "/")[0].cast("int")).alias("deepest"))
    tiles.bounds(stars).join(F.broadcast(deepest)).withColumn("record_bytes", F.lit(tiles.RECORD_BYTES)).write.mode("overwrite").json(f"{folder}/sky")
    return files.select("path").distinct().count()


def slice_canon(canon: Canon, keep: int = slicing.KEEP, dry_run: bool = False) -> int:
    """Reduce the canon to its brightest artists; returns how many artists go."""
    gone = 0

    def build(at: Snapshot) -> dict:
        nonlocal gone
        positions, weights = newest(at)
        total = at.read("artist").count()
        if total <= keep:
            raise ValueError(f"the canon has {total} artists, no more than {keep}")
        kept = stage(slicing.kept(positions, weights, keep), "kept")
        gone = total - kept.count()
        if dry_run:
            return {}
        tables = {}
        for name in {t for t, _ in FK_TO_ARTIST} | (at.entries.keys() - {LEDGER}):
            parts = at.entries.get(name, {})
            at.folders(name)  # a table that is filled meanwhile has to be cut as well
            for part in parts:
                cut = slicing.cut({"artist": at.read("artist"), name: at.read(name, part)}, kept)
                tables[(name, part) if name in PARTS else name] = cut[name]
        return tables

    if dry_run:
        build(canon.snapshot())
    else:
        canon.update("slice", str(keep), build)
    return gone


def card(canon: Canon, artist_id: int) -> DataFrame:
    """One artist's card; no row if unknown. Every table is read in the order of what is asked for, so that few row groups
    are read: edges from both ends, then the names of at most ten neighbours and the genres of one artist."""
    at = canon.snapshot()
    last = at.read("sky_layout").orderBy(F.desc("created_at"), F.desc("id")).first()
    if last is None:
        raise ValueError("lay the graph out first: there is no layout")
    mine = lambda df, c="artist_id": df.where(F.col(c) == artist_id)
    edges = mine(at.read("artist_similarity", by="source_id"), "source_id").unionByName(mine(at.read("artist_similarity", by="target_id"), "target_id"))
    best = serve.best_neighbours(edges, artist_id).collect()
    near = canon.spark.createDataFrame([tuple(r) for r in best], "artist_id int, rank int, other_id int, score float")
    near = near.join(at.read("artist").where(F.col("id").isin([r.other_id for r in best])).select(F.col("id").alias("other_id"), "name"), "other_id")
    tags = serve.top_genres(mine(at.read("artist_genre")), at.read("genre"))
    return serve.cards(mine(at.read("artist"), "id"), mine(at.read("artist_position", last.id)), mine(at.read("artist_prominence", last.metric_id)), tags, near)


def search(canon: Canon, term: str) -> DataFrame:
    return serve.search(canon.read("artist"), *newest(canon), term).select("id", "name", "comment", "x", "y")


def health(spark: SparkSession, canon: Canon) -> dict[str, bool]:
    return {"spark": spark.range(1).count() == 1, "canon": bool(canon.manifest())}
