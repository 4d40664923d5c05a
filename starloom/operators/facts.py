"""Facts from entity records: origin, inception, country, genres, labels, influences and the labels they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import item_number, signed_year

ENTITY = (
    "id string, labels map<string,struct<value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>, sitelinks map<string,struct<title:string>>"
)
#: Property numbers of the entity records (fixed values).
ARTIST_ID, FORMED_IN, BORN_IN, INCEPTION, COUNTRY, GENRE, LABEL, INFLUENCED_BY = "P434", "P740", "P19", "P571", "P495", "P136", "P264", "P737"


def _body(line: Column) -> Column:
    return F.rtrim(F.trim(F.regexp_replace(line, r",\s*\z", "")))


def is_entity(line: Column) -> Column:
    """Whether entities() keeps a line."""
    return ~_body(line).isin("", "[", "]") & F.from_json(_body(line), "id string")["id"].isNotNull()


def _once(value: Column) -> Column:
    """The value, worked out once for a row: Spark copies what an alias stands for into each later condition that names it,
    but not what comes out of an explode."""
    return F.explode_outer(F.array(value))


def entities(lines: DataFrame) -> DataFrame:
    """Entities of text lines (value): an array's brackets, blank and malformed lines go."""
    rows = lines.select(_once(_body(F.col("value"))).alias("body")).where(~F.col("body").isin("", "[", "]")).select(_once(F.from_json("body", ENTITY)).alias("e"))
    return rows.where("e.id is not null").select("e.*")


def values(claims: Column, prop: str) -> Column:
    """array<string>: a property's values, statement by statement (null for those without one)."""
    return F.transform(claims[prop], lambda s: s["mainsnak"]["datavalue"]["value"])


def linked(claims: Column, prop: str) -> Column:
    """array<int>: the Q-numbers that a property's values name."""
    numbers = F.transform(F.transform(values(claims, prop), lambda v: F.get_json_object(v, "$.id")), item_number)
    return F.coalesce(F.filter(numbers, lambda n: n.isNotNull()), F.array().cast("array<int>"))


#: Properties that facts read.
READ = (ARTIST_ID, FORMED_IN, BORN_IN, INCEPTION, COUNTRY, GENRE, LABEL, INFLUENCED_BY)


def slim(entities: DataFrame) -> DataFrame:
    """Entities with no more than facts() and referenced_items() read: English labels and titles, and of those with an
    artist id the claims of a few properties."""
    only = lambda c, keys: F.map_filter(c, lambda k, _: k.isin(*keys))
    claims = F.when(F.col("claims")[ARTIST_ID].isNotNull(), only("claims", READ))
    return entities.select("id", only("labels", ["en"]).alias("labels"), claims.alias("claims"), only("sitelinks", ["enwiki"]).alias("sitelinks"))


#: What facts() gives of each artist, in SQL.
FACTS = ["artist_id", "qid", "enwiki_title", "origin.qid AS origin_qid", "origin.is_birth AS origin_is_birth", "inception_year", "country_qid", "genres", "labels", "influenced_by"]


def facts(entities: DataFrame, artists: DataFrame) -> DataFrame:
    """A row for each known artist. An entity stands for the first of its artist ids that is known; of several
    entities the greatest Q-number wins. Formation goes before birth as origin. Entities without an artist id go, and
    what facts need is taken out of the claims, before anything is shuffled."""
    claims = F.col("claims")
    places = F.array(F.struct(F.get(linked(claims, FORMED_IN), F.lit(0)).alias("formed"), F.get(linked(claims, BORN_IN), F.lit(0)).alias("born")))
    is_birth = lambda p: F.when(p["formed"].isNotNull(), False).when(p["born"].isNotNull(), True)
    origin = F.transform(places, lambda p: F.struct(F.coalesce(p["formed"], p["born"]).alias("qid"), is_birth(p).alias("is_birth")))[0]
    fact = F.struct(
        F.col("sitelinks")["enwiki"]["title"].alias("enwiki_title"),
        origin.alias("origin"),
        signed_year(F.get_json_object(F.get(values(claims, INCEPTION), F.lit(0)), "$.time")).alias("inception_year"),
        F.get(linked(claims, COUNTRY), F.lit(0)).alias("country_qid"),
        linked(claims, GENRE).alias("genres"),
        linked(claims, LABEL).alias("labels"),
        linked(claims, INFLUENCED_BY).alias("influenced_by"),
    )
    items = entities.where(claims[ARTIST_ID].isNotNull()).select(item_number(F.col("id")).alias("qid"), values(claims, ARTIST_ID).alias("mbids"), fact.alias("fact"))
    items = items.select("qid", F.posexplode_outer("mbids").alias("pos", "mbid"), "fact").where("qid is not null and mbid is not null")
    known = items.join(artists.select(F.col("id").alias("artist_id"), "mbid"), "mbid")
    owned = known.groupBy("qid").agg(F.min_by(F.struct("artist_id", "fact"), "pos").alias("o")).select("o.artist_id", "qid", "o.fact")
    return owned.groupBy("artist_id").agg(F.max_by(F.struct("qid", "fact"), "qid").alias("f")).select("artist_id", "f.qid", "f.fact.*").selectExpr(*FACTS)


def counted(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: entities read, those with an artist id, and artists kept."""
    read = entities.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("claims")[ARTIST_ID].isNotNull()).alias("with_artist_id"))
    return read.crossJoin(F.broadcast(facts.agg(F.count(F.lit(1)).alias("kept"))))


def influences(facts: DataFrame) -> DataFrame:
    """(artist_id, influence_id): directed, between known artists, never to oneself."""
    return influence_edges(facts.select("artist_id", F.explode("influenced_by").alias("far_qid")), facts.select("qid", "artist_id"))


def influence_edges(claims: DataFrame, owners: DataFrame) -> DataFrame:
    """claims(artist_id, far_qid) resolved by owners(qid, artist_id)."""
    far = owners.select(F.col("qid").alias("far_qid"), F.col("artist_id").alias("influence_id"))
    return claims.join(far, "far_qid").where("artist_id <> influence_id").select("artist_id", "influence_id").distinct()


def referenced_items(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, label) of every item that facts refer to, other than by influence; the label may be missing."""
    used = facts.select(F.explode(F.concat(F.array("origin_qid", "country_qid"), "genres", "labels")).alias("qid")).where("qid is not null").distinct()
    named = entities.select(item_number(F.col("id")).alias("qid"), F.col("labels")["en"]["value"].alias("label")).where("qid is not null")
    return used.join(named.groupBy("qid").agg(F.max("label").alias("label")), "qid", "left")
