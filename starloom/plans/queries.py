"""Every operator as a query over the given tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, parsing
from ..operators import backbone, facts, genres, layout, prose, serve, similarity, slicing, tiles
from ..sources import dumps
from ..store import first_wins, merged, numbered
from . import canon
from .canon import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views of the given tables in SQL, by name; a query lists those it needs in order.
VIEWS = {
    "credits": "SELECT o_orderkey AS id, o_custkey AS artist_id FROM orders",
    "relations": """SELECT * FROM (SELECT l_orderkey AS id_0, lead(l_orderkey) OVER w AS id_1, CAST(least(l_discount, lead(l_discount) OVER w) * 10 AS FLOAT) AS score
        FROM lineitem WHERE l_linenumber = 1 WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey)) WHERE id_1 IS NOT NULL""",
    "judged": """SELECT r.*, a.artist_id AS a, b.artist_id AS b, CASE WHEN id_0 IS NULL OR id_1 IS NULL OR score IS NULL THEN 'malformed' WHEN score < CAST(0.1 AS FLOAT) THEN 'weak'
        WHEN a.artist_id IS NULL OR b.artist_id IS NULL THEN 'unknown' WHEN a.artist_id = b.artist_id THEN 'self' ELSE 'kept' END AS outcome
        FROM relations r LEFT JOIN credits a ON a.id = id_0 LEFT JOIN credits b ON b.id = id_1""",
    "edges": "SELECT least(a, b) AS source_id, greatest(a, b) AS target_id, max(score) AS score FROM judged WHERE outcome = 'kept' GROUP BY 1, 2",
    "ways": "SELECT source_id AS artist_id, target_id AS other_id, score FROM edges UNION ALL SELECT target_id, source_id, score FROM edges",
    "prominence": "SELECT artist_id, CAST(count(*) AS INTEGER) AS degree, sum(CAST(score AS DOUBLE)) AS weight FROM ways GROUP BY 1",
    "supplier_edges": """SELECT least(a, b) AS source_id, greatest(a, b) AS target_id, CAST(count(*) AS DOUBLE) AS score FROM
        (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2""",
    "supplier_ways": "SELECT source_id AS artist_id, target_id AS other_id, score FROM supplier_edges UNION ALL SELECT target_id, source_id, score FROM supplier_edges",
    "tags": """SELECT o_custkey AS artist, p_type AS name, false AS is_style FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT o_custkey, p_brand, true FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "vocabulary": "SELECT CAST(row_number() OVER (ORDER BY name, is_style) AS INTEGER) AS id, name, is_style FROM (SELECT DISTINCT name, is_style FROM tags)",
    "genre_counts": "SELECT artist, name, is_style, count(*) AS releases FROM tags GROUP BY ALL",
    "artist_genres": "SELECT c_nationkey AS artist_id, v.id AS genre_id, CAST(sum(releases) AS BIGINT) AS releases FROM genre_counts g JOIN customer ON c_custkey = artist JOIN vocabulary v USING (name, is_style) GROUP BY 1, 2",
    "event_facts": """SELECT user_id AS artist_id, CAST(max(event_id) AS INTEGER) AS qid, arg_max(event_type IN ('purchase', 'click'), event_id) AS formed,
        CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS INTEGER) AS k, CAST(arg_max(year(ts), event_id) AS SMALLINT) AS inception_year FROM events GROUP BY 1""",
    "positions": "SELECT vec_id AS artist_id, embedding[1] AS x, embedding[2] AS y FROM embeddings",
    "weights": "SELECT vec_id AS artist_id, CAST(label + 1 AS DOUBLE) AS weight FROM embeddings",
    "stars": """SELECT artist_id, x, y, CAST(sqrt(CAST(CAST(weight AS FLOAT) / (SELECT greatest(max(CAST(weight AS FLOAT)), CAST(1.1754944e-38 AS FLOAT)) FROM weights) AS FLOAT)) AS FLOAT) AS brightness
        FROM positions JOIN weights USING (artist_id)""",
    "half": """SELECT (min(x) + max(x)) / CAST(2 AS FLOAT) AS cx, (min(y) + max(y)) / CAST(2 AS FLOAT) AS cy,
        CAST(greatest(greatest(max(x) - min(x), max(y) - min(y)) / CAST(2 AS FLOAT), CAST(0.001 AS FLOAT)) * CAST(1.02 AS FLOAT) AS FLOAT) AS half FROM stars""",
    "bounds": "SELECT CAST(cx - half AS FLOAT) AS min_x, CAST(cy - half AS FLOAT) AS min_y, CAST(half * CAST(2 AS FLOAT) AS FLOAT) AS span FROM half",
    "ranked": "SELECT *, row_number() OVER (ORDER BY brightness DESC, artist_id) AS rank FROM stars",
    "levels": "SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS level",
    "last": "SELECT coalesce(min(level) FILTER (WHERE 50 * (1 << (2 * level)) >= (SELECT count(*) FROM stars)), 6) AS deepest FROM levels",
    "pyramid": """SELECT level, least(greatest(CAST(floor(CAST(CAST((x - min_x) / span AS FLOAT) * CAST(1 << level AS FLOAT) AS FLOAT)) AS INTEGER), 0), (1 << level) - 1) AS col,
        least(greatest(CAST(floor(CAST(CAST((y - min_y) / span AS FLOAT) * CAST(1 << level AS FLOAT) AS FLOAT)) AS INTEGER), 0), (1 << level) - 1) AS "row", rank, artist_id, x, y, brightness
        FROM ranked, bounds, levels, last WHERE level <= deepest AND rank <= 50 * (1 << (2 * level))""",
    "kept": "SELECT artist_id FROM positions LEFT JOIN weights USING (artist_id) ORDER BY coalesce(weight, 0) DESC, artist_id LIMIT 100",
}
LEVEL0, KEEP, LEAST_SCORE = 50, 100, 0.1


def query(views: str = "", sql: str = ""):
    """Register a function of Tables under its name, with the SQL over the named views."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            ORACLE_SQL[f.__name__] = f"WITH {with_} {sql}" if with_ else sql
        return f

    return add


# Backbone


@query(sql="""SELECT c_custkey AS id, 'm' || c_custkey AS mbid, c_name AS name, lower(c_name) AS sort_name, c_acctbal < 0 AS ended, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS comment,
    begin_year, end_year, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS kind, n_name AS area, r_name AS area_code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS begin_year, CAST(max(year(o_orderdate)) AS INTEGER) AS end_year FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def artist_dim(t):
    return backbone.artists(canon.artist_rows(t), canon.kinds(t), canon.areas(t), canon.area_codes(t))


@query(sql="""SELECT o_orderkey AS id, 'g' || o_orderkey AS mbid, 'order ' || o_orderkey AS name, substr(o_orderpriority, 3) AS primary_type, o_custkey AS artist_id, "year"
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(year(l_shipdate)) AS INTEGER) AS "year" FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1) ON l_orderkey = o_orderkey""")
def release_group_year(t):
    n = canon.parts(t)
    years = backbone.group_years(canon.dates(t), canon.releases(t), n)
    return backbone.release_groups(canon.groups(t), canon.credits(t), canon.group_kinds(t), years, n)


@query(sql="SELECT DISTINCT page_id + 1 AS artist_id, r_name AS kind, url FROM pages JOIN region ON r_regionkey = page_id % 5 JOIN customer ON c_custkey = page_id + 1 WHERE r_regionkey < 3")
def artist_url_resolved(t):
    kinds = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit("artist").alias("from"), F.when(F.col("r_regionkey") < 3, "url").otherwise("label").alias("to"), F.col("r_name").alias("name"))
    links = t.pages.select(F.col("page_id").alias("link"), (F.col("page_id") + 1).alias("artist_id"), F.col("page_id").alias("url_id"))
    link = t.pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 5).alias("kind_id"))
    return backbone.artist_urls(links, link, kinds, t.pages.select(F.col("page_id").alias("id"), "url"), canon.artists(t))


@query(sql="SELECT page_id, CASE WHEN strpos(url, '/en/') > 0 THEN TRY_CAST(regexp_extract(substr(url, strpos(url, '/en/') + 4), '^[0-9]+') AS INTEGER) END AS found FROM pages")
def url_id_extract(t):
    return t.pages.select("page_id", parsing.id_after(F.col("url"), "/en/").alias("found"))


@query(sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS version FROM orders""")
def url_version_date(t):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(F.lit("dump_"), day, F.when(F.col("o_orderkey") % 3 == 0, "9.xml.gz").otherwise("_masters.xml.gz"))
    return t.orders.select("o_orderkey", parsing.file_version(name, "dump_").alias("version"))


@query(sql="SELECT l_orderkey AS id, l_suppkey AS artist_id FROM lineitem WHERE l_linenumber = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def credit_first_artist(t):
    names = t.lineitem.select(F.col("l_orderkey").alias("credit"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_suppkey").alias("artist"))
    return backbone.first_credits(names, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


# Similarity


@query("credits relations judged edges", "SELECT source_id, target_id, round(CAST(score AS DOUBLE), 6) AS score FROM edges")
def similarity_edges(t):
    return _edges(t).withColumn("score", F.round(F.col("score").cast("double"), 6))


def _edges(t: Tables) -> DataFrame:
    return similarity.edges(canon.relations(t), canon.credits(t), LEAST_SCORE)


def _supplier_edges(t: Tables) -> DataFrame:
    return similarity.collapsed(canon.supplier_pairs(t), F.sum("score"))


@query("credits relations judged", "SELECT id_0, id_1, a, b, outcome FROM judged")
def similarity_resolved(t):
    return similarity.judged(canon.relations(t), canon.credits(t), LEAST_SCORE).select("id_0", "id_1", "a", "b", "outcome")


@query("credits relations judged", "SELECT outcome, count(*) AS relations FROM judged GROUP BY 1")
def similarity_stats(t):
    return similarity.judged(canon.relations(t), canon.credits(t), LEAST_SCORE).groupBy("outcome").agg(F.count(F.lit(1)).alias("relations"))


@query("supplier_edges", "SELECT * FROM supplier_edges")
def supplier_similarity(t):
    return _supplier_edges(t)


@query("credits relations judged edges ways prominence", "SELECT artist_id, degree, round(weight, 5) AS weight FROM prominence")
def prominence(t):
    return similarity.prominence(_edges(t)).withColumn("weight", F.round("weight", 5))


@query("credits relations judged edges ways prominence", "SELECT artist_id, degree, round(weight, 5) AS weight FROM prominence ORDER BY round(weight, 5) DESC, artist_id LIMIT 12")
def prominence_top(t):
    return prominence(t).orderBy(F.desc("weight"), "artist_id").limit(12)


# Genres


def _tags(t: Tables) -> DataFrame:
    return genres.tagged(canon.masters(t))


def _customers(t: Tables, where: str = "true") -> DataFrame:
    return t.customer.where(where).select(F.col("c_custkey").alias("artist"), F.col("c_nationkey").alias("artist_id"))


def _nations(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def _artist_genres(t: Tables) -> tuple[DataFrame, DataFrame]:
    tags, n = _tags(t), canon.parts(t)
    words = genres.vocabulary(tags)
    return genres.summed(genres.counts(tags, _customers(t), parts=n), _customers(t), words, n), words


@query("tags vocabulary", "SELECT * FROM vocabulary")
def genre_vocab(t):
    return genres.vocabulary(_tags(t))


@query("tags genre_counts", "SELECT * FROM genre_counts")
def artist_genre_counts(t):
    return genres.counts(_tags(t), _customers(t), parts=canon.parts(t))


@query("tags vocabulary genre_counts artist_genres", "SELECT * FROM artist_genres ORDER BY ALL")
def artist_genre_summed(t):
    return _artist_genres(t)[0].orderBy("artist_id", "genre_id")


@query("tags vocabulary genre_counts artist_genres", """SELECT artist_id, CAST(rank AS INTEGER) AS rank, name, is_style, releases FROM (SELECT artist_id, releases, name, is_style,
    row_number() OVER (PARTITION BY artist_id ORDER BY releases DESC, name, is_style) AS rank FROM artist_genres JOIN vocabulary ON id = genre_id) WHERE rank <= 8""")
def artist_genre_top8(t):
    return serve.top_genres(*_artist_genres(t)).select("artist_id", "rank", "name", "is_style", "releases")


@query("tags vocabulary genre_counts artist_genres", "SELECT n_nationkey AS id, v.name AS genre, is_style, releases FROM artist_genres JOIN vocabulary v ON v.id = genre_id JOIN nation ON n_nationkey = artist_id WHERE n_name = 'FRANCE'")
def genres_of_name(t):
    return genres.of_name(*_artist_genres(t), _nations(t), "FRANCE")


@query(sql="SELECT n_nationkey AS id, n_name AS name, min(c_custkey) AS discogs_id FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def catalogue_entries(t):
    return genres.entries(_customers(t).groupBy("artist_id").agg(F.min("artist").alias("discogs_id")), _nations(t))


@query("tags", "SELECT artist, name, is_style, count(*) AS releases FROM tags JOIN customer ON c_custkey = artist WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' GROUP BY ALL")
def masters_semi(t):
    return genres.counts(_tags(t), _customers(t, "c_acctbal > 0"), _customers(t, "c_mktsegment = 'BUILDING'"), canon.parts(t))


@query(sql="SELECT p.p_partkey AS id, p.p_name AS name, p.p_brand AS profile, CASE WHEN q.p_partkey <> p.p_partkey THEN q.p_partkey END AS parent_label_id FROM part p LEFT JOIN part q ON q.p_partkey = p.p_size")
def label_parents(t):
    return genres.with_parents(canon.label_rows(t))


@query(sql="""SELECT p.p_partkey AS id, p.p_name AS name, q.p_name AS parent FROM part p JOIN part q ON q.p_partkey = p.p_size WHERE q.p_partkey <> p.p_partkey""")
def label_parent_names(t):
    rows = genres.with_parents(canon.label_rows(t))
    return rows.join(rows.select(F.col("id").alias("parent_label_id"), F.col("name").alias("parent")), "parent_label_id").select("id", "name", "parent")


# Sinks


@query(sql="SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def dedupe_first_wins(t):
    return first_wins(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(sql="SELECT l_partkey, count(*) AS releases FROM lineitem GROUP BY 1")
def upsert_merge(t):
    counted = lambda where: t.lineitem.where(where).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("releases"))
    return merged(counted("l_returnflag = 'A'"), counted("l_returnflag <> 'A'"), ["l_partkey"], "releases")


@query(sql="SELECT CAST(row_number() OVER (ORDER BY CASE WHEN r_regionkey IS NOT NULL THEN 0 ELSE 1 END, r_regionkey, key) AS INTEGER) AS id, key FROM (SELECT DISTINCT c_mktsegment AS key, NULL AS r_regionkey FROM customer UNION ALL SELECT r_name, r_regionkey FROM region)")
def registry_numbers(t):
    old = t.region.select((F.col("r_regionkey") + 1).cast("int").alias("id"), F.col("r_name").alias("key"))
    return numbered(old, t.customer.select(F.col("c_mktsegment").alias("key")), "key")


# Facts


def _facts(t: Tables) -> DataFrame:
    return facts.facts(facts.entities(canon.entity_lines(t)), canon.users(t))


@query("event_facts", "SELECT artist_id, qid, 'User ' || artist_id AS enwiki_title FROM event_facts")
def facts_json(t):
    return _facts(t).select("artist_id", "qid", "enwiki_title")


@query("event_facts", "SELECT artist_id, k AS origin_qid, NOT formed AS origin_is_birth FROM event_facts")
def facts_origin_pref(t):
    return _facts(t).select("artist_id", "origin_qid", "origin_is_birth")


@query("event_facts", "SELECT artist_id, inception_year FROM event_facts")
def facts_year(t):
    return _facts(t).select("artist_id", "inception_year")


@query("event_facts", "SELECT artist_id, f.k AS origin_qid, e.event_type || ' ' || e.event_id AS origin FROM event_facts f LEFT JOIN events e ON e.event_id = f.k")
def facts_card(t):
    rows = _facts(t)
    items = facts.referenced_items(rows, facts.entities(canon.entity_lines(t))).select(F.col("qid").alias("origin_qid"), F.col("label").alias("origin"))
    return rows.join(items, "origin_qid", "left").select("artist_id", "origin_qid", "origin")


@query("event_facts", "SELECT k AS qid, any_value(e.event_type || ' ' || e.event_id) AS label FROM event_facts f LEFT JOIN events e ON e.event_id = f.k GROUP BY 1")
def item_labels(t):
    return facts.referenced_items(_facts(t), facts.entities(canon.entity_lines(t)))


def _influences(t: Tables) -> DataFrame:
    claims = t.events.select(F.col("user_id").alias("artist_id"), F.get_json_object("props", "$.k").cast("bigint").alias("far_qid"))
    return facts.influence_edges(claims, canon.users(t).select(F.col("id").alias("qid"), F.col("id").alias("artist_id")))


_INFLUENCE = "SELECT DISTINCT e.user_id AS artist_id, u.user_id AS influence_id FROM events e JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = CAST(json_extract_string(props, '$.k') AS BIGINT) WHERE e.user_id <> u.user_id"


@query(sql=_INFLUENCE)
def influence_edges(t):
    return _influences(t)


@query(sql=f"SELECT a.c_name AS artist, b.c_name AS influence FROM ({_INFLUENCE}) i JOIN customer a ON a.c_custkey = i.artist_id JOIN customer b ON b.c_custkey = i.influence_id")
def influence_names(t):
    name = lambda key, out: canon.artists(t).select(F.col("id").alias(key), F.col("name").alias(out))
    return _influences(t).join(name("artist_id", "artist"), "artist_id").join(name("influence_id", "influence"), "influence_id").select("artist", "influence")


# Text


@query(sql="SELECT page_id // 10 AS \"offset\", array_to_string(list_sort(list(DISTINCT url)), ' ') AS titles FROM pages WHERE contains(url, '/en/') GROUP BY 1")
def index_titles(t):
    lines = t.pages.select(F.concat_ws(":", F.floor(F.col("page_id") / 10), "page_id", "url").alias("value"))
    found = dumps.wanted_streams(dumps.index(lines), t.pages.where(F.contains("url", F.lit("/en/"))).select(F.col("url").alias("title")))
    return found.select("offset", F.array_join("titles", " ").alias("titles"))


_ENTITIES = (("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&amp;", "&"))


def _replaced(sql: str, pairs) -> str:
    for a, b in pairs:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


_STRIPPED = r"regexp_replace(html, '<!--.*?(?:-->|\z)', '', 'gs')"
for _tag in ("script", "style"):
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '<{_tag}\b.*?(?:</{_tag}>|\z)', ' ', 'gsi')"
_STRIPPED = rf"trim(regexp_replace({_replaced(f"regexp_replace({_STRIPPED}, '<[^>]*>', ' ', 'g')", _ENTITIES)}, '\s+', ' ', 'g'))"


@query(sql=f"SELECT page_id, length({_STRIPPED}) AS n_chars, md5({_STRIPPED}) AS digest FROM pages")
def html_strip(t):
    rows = t.pages.select("page_id", markup.page_text(F.col("html")).alias("x"))
    return rows.select("page_id", F.length("x").cast("bigint").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query(sql=f"SELECT page_id, md5({_replaced('html', _ENTITIES)}) AS digest, md5({_replaced('html', (('&lt;', '<'), ('&gt;', '>'), ('&quot;', chr(34)), ('&#039;', chr(39) * 2), ('&apos;', chr(39) * 2), ('&amp;', '&')))}) AS unescaped, md5({_replaced('html', (('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), (chr(34), '&quot;')))}) AS escaped FROM pages")
def html_entities(t):
    md5 = lambda c, out: F.md5(c.cast("binary")).alias(out)
    return t.pages.select("page_id", md5(markup.decode_entities(F.col("html")), "digest"), md5(parsing.xml_unescape(F.col("html")), "unescaped"), md5(parsing.xml_escape(F.col("html")), "escaped"))


_PARAGRAPHS = r"""list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*(?:\n[ \t]*)+'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)),
    lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[*#:;|!=]')), ' ')), lambda p: strlen(p) > 40 AND contains(p, ' '))"""


@query(sql=f"SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, chr(10) || chr(10))) AS digest FROM (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents)")
def prose_paragraphs(t):
    rows = t.documents.select("doc_id", markup.paragraphs(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").cast("bigint").alias("paragraphs"), F.md5(F.array_join("p", "\n\n").cast("binary")).alias("digest"))


@query(sql=f"SELECT doc_id, length(text) AS source_chars, length(array_to_string(p, chr(10) || chr(10))) AS extract_chars, round(100.0::DOUBLE * length(array_to_string(p, chr(10) || chr(10))) / nullif(length(text), 0), 4) AS share FROM (SELECT doc_id, text, {_PARAGRAPHS} AS p FROM documents)")
def prose_ratio(t):
    rows = t.documents.select("doc_id", F.length("text").cast("bigint").alias("source_chars"), F.length(F.array_join(markup.paragraphs(F.col("text")), "\n\n")).cast("bigint").alias("extract_chars"))
    return rows.withColumn("share", F.round(F.lit(100.0) * F.col("extract_chars") / F.nullif("source_chars", F.lit(0)), 4))


@query(sql=f"""SELECT c_custkey AS id, c_name AS name, 'page ' || doc_id AS source_title, '{prose.BASE_URL}page_' || doc_id AS source_url, '{prose.LICENCE}' AS licence, 'v1' AS dump_version,
    round(100.0::DOUBLE * length(array_to_string(p, chr(10) || chr(10))) / nullif(length(text), 0), 1) AS share FROM (SELECT doc_id, text, {_PARAGRAPHS} AS p FROM documents) JOIN customer ON c_custkey = doc_id""")
def prose_attribution(t):
    title, extract = F.concat(F.lit("page "), "doc_id"), F.array_join(markup.paragraphs(F.col("text")), "\n\n")
    rows = t.documents.select(
        F.col("doc_id").alias("artist_id"), title.alias("source_title"), parsing.page_url(title, prose.BASE_URL).alias("source_url"), F.lit(prose.LICENCE).alias("licence"), F.lit("v1").alias("dump_version"),
        F.length("text").alias("source_chars"), F.length(extract).alias("extract_chars"),
    )
    return prose.attribution(rows, canon.artists(t))


@query()
def prose_lead(t):
    return t.documents.select("doc_id", markup.lead(F.col("text")).alias("extract"))


@query(sql="SELECT CAST(doc_id AS INTEGER) AS doc_id, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def copy_text_decode(t):
    text = F.col("text")
    for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    line = F.concat_ws("\t", "doc_id", text, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("\\N")))
    fields = t.documents.select(parsing.copy_fields(line).alias("f"))
    return fields.select(parsing.whole_number(F.col("f")[0]).alias("doc_id"), F.md5(F.col("f")[1].cast("binary")).alias("digest"), F.col("f")[2].alias("lang"))


# Serving


@query("positions weights", """SELECT c_custkey AS id, c_name AS name, x, y FROM customer JOIN positions ON artist_id = c_custkey LEFT JOIN weights USING (artist_id) WHERE c_name ILIKE '%00001%'
    ORDER BY (lower(c_name) = '00001') DESC, coalesce(weight, 0) DESC, (c_name ILIKE '00001%') DESC, length(c_name), c_name, c_custkey LIMIT 12""")
def search_hits(t):
    return serve.search(canon.artists(t), canon.positions(t), canon.weights(t), " 00001 ").select("id", "name", "x", "y")


@query("credits relations judged edges ways", """SELECT artist_id, CAST(rank AS INTEGER) AS rank, other_id, c_name AS name, round(CAST(score AS DOUBLE), 6) AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY score DESC, other_id) AS rank FROM ways) JOIN customer ON c_custkey = other_id WHERE rank <= 10""")
def neighbours_top10(t):
    return serve.top_neighbours(_edges(t), canon.artists(t)).select("artist_id", "rank", "other_id", "name", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("credits relations judged edges ways tags vocabulary genre_counts positions weights", """SELECT c_custkey AS id, c_name AS name, x, y, coalesce(weight, 0) AS brightness, coalesce(g.n, 0) AS genres, g.best AS best_genre, coalesce(s.n, 0) AS similar, s.nearest AS nearest FROM customer
    LEFT JOIN positions ON artist_id = c_custkey LEFT JOIN weights USING (artist_id)
    LEFT JOIN (SELECT artist, least(count(*), 8) AS n, arg_min(name, (-releases, name, is_style)) AS best FROM genre_counts GROUP BY 1) g ON g.artist = c_custkey
    LEFT JOIN (SELECT artist_id AS a, least(count(*), 10) AS n, arg_min(other_id, (-score, other_id)) AS nearest FROM ways GROUP BY 1) s ON s.a = c_custkey""")
def star_card(t):
    tags = _tags(t)
    words = genres.vocabulary(tags)
    counted = genres.counts(tags, _customers(t), parts=canon.parts(t)).join(words, ["name", "is_style"]).select(F.col("artist").alias("artist_id"), F.col("id").alias("genre_id"), "releases")
    rows = serve.cards(canon.artists(t), canon.positions(t), canon.weights(t), serve.top_genres(counted, words), serve.top_neighbours(_edges(t), canon.artists(t)))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint").alias(c)
    return rows.select("id", "name", "position.x", "position.y", F.coalesce("position.brightness", F.lit(0.0)).alias("brightness"), n("genres"), F.col("genres")[0]["name"].alias("best_genre"), n("similar"), F.col("similar")[0]["other_id"].alias("nearest"))


@query(sql="SELECT vec_id AS artist_id, CASE WHEN vec_id % 2 = 0 THEN embedding[3] ELSE embedding[1] END AS x, CASE WHEN vec_id % 2 = 0 THEN embedding[4] ELSE embedding[2] END AS y, 1 AS metric_id FROM embeddings")
def newest_layout(t):
    old = t.embeddings.select(F.lit(0).alias("layout_id"), F.col("vec_id").alias("artist_id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    new = t.embeddings.where("vec_id % 2 = 0").select(F.lit(1).alias("layout_id"), F.col("vec_id").alias("artist_id"), F.col("embedding")[2].alias("x"), F.col("embedding")[3].alias("y"))
    layouts = t.region.select(F.col("r_regionkey").alias("id"), F.lit(1).alias("metric_id"), F.col("r_regionkey").alias("created_at"))
    return serve.newest(old.unionByName(new), layouts)


# Tiles


def _stars(t: Tables) -> DataFrame:
    return tiles.stars(canon.positions(t), canon.weights(t))


@query("positions weights stars", "SELECT artist_id, x, y, brightness FROM stars")
def star_brightness(t):
    return _stars(t)


@query("positions weights stars half bounds", "SELECT round(CAST(min_x AS DOUBLE), 5) AS min_x, round(CAST(min_y AS DOUBLE), 5) AS min_y, round(CAST(span AS DOUBLE), 5) AS span FROM bounds")
def sky_bounds(t):
    return tiles.bounds(_stars(t)).select(*(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("min_x", "min_y", "span")))


@query("positions weights stars half bounds levels", """SELECT artist_id, level, least(greatest(CAST(floor(CAST(CAST((x - min_x) / span AS FLOAT) * CAST(1 << level AS FLOAT) AS FLOAT)) AS INTEGER), 0), (1 << level) - 1) AS col,
    least(greatest(CAST(floor(CAST(CAST((y - min_y) / span AS FLOAT) * CAST(1 << level AS FLOAT) AS FLOAT)) AS INTEGER), 0), (1 << level) - 1) AS "row" FROM stars, bounds, levels WHERE level < 4""")
def tile_assign(t):
    s = _stars(t)
    rows = s.join(F.broadcast(tiles.bounds(s))).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    at = lambda c, c0: tiles.tile_of(F.col(c), F.col(c0), F.col("span"), F.col("level"))
    return rows.select("artist_id", "level", at("x", "min_x").alias("col"), at("y", "min_y").alias("row"))


_PYRAMID = "positions weights stars half bounds ranked levels last pyramid"


@query(_PYRAMID, 'SELECT level, col, "row", rank, artist_id FROM pyramid')
def tile_pyramid(t):
    return tiles.pyramid(_stars(t), LEVEL0).select("level", "col", "row", "rank", "artist_id")


@query(_PYRAMID, 'SELECT level, col, "row", count(*) AS stars FROM pyramid GROUP BY ALL')
def tile_counts(t):
    return tiles.pyramid(_stars(t), LEVEL0).groupBy("level", "col", "row").agg(F.count(F.lit(1)).alias("stars"))


@query(_PYRAMID, "SELECT level, count(*) AS stars, count(*) = (SELECT count(*) FROM stars) AS complete FROM pyramid GROUP BY 1")
def tile_level_stop(t):
    s = _stars(t)
    levels = tiles.pyramid(s, LEVEL0).groupBy("level").agg(F.count(F.lit(1)).alias("stars"))
    return levels.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("all")))).select("level", "stars", (F.col("stars") == F.col("all")).alias("complete"))


@query()
def tile_bytes(t):
    return tiles.files(tiles.pyramid(_stars(t), LEVEL0))


@query("positions", "SELECT artist_id FROM positions WHERE (x - 0.1) * (x - 0.1) + (y + 0.05) * (y + 0.05) < 0.25 ORDER BY (CAST(x AS DOUBLE) - 0.1) * (CAST(x AS DOUBLE) - 0.1) + (CAST(y AS DOUBLE) + 0.05) * (CAST(y AS DOUBLE) + 0.05), artist_id LIMIT 1")
def nearest_star(t):
    d2 = F.pow(F.col("x").cast("double") - 0.1, 2) + F.pow(F.col("y").cast("double") + 0.05, 2)
    return canon.positions(t).withColumn("d2", d2).where("d2 < 0.25").orderBy("d2", "artist_id").limit(1).select("artist_id")


# Layout


@query("supplier_edges supplier_ways", "SELECT artist_id, count(*) AS degree, sum(score) AS mass, CAST(row_number() OVER (ORDER BY artist_id) - 1 AS BIGINT) AS index, array_to_string(list(other_id ORDER BY other_id), ',') AS targets FROM supplier_ways GROUP BY 1")
def graph_csr(t):
    e = _supplier_edges(t)
    rows = layout.spiral(layout.nodes(e)).select("artist_id", "degree", "mass", "index")
    targets = similarity.both_ways(e).groupBy("artist_id").agg(F.array_join(F.sort_array(F.collect_list("other_id")), ",").alias("targets"))
    return rows.join(targets, "artist_id")


@query("supplier_edges supplier_ways", "SELECT artist_id, round(sqrt(i) * cos(i * (pi() * (3 - sqrt(5))) + radians(24301 % 360)), 5) + 0.0::DOUBLE AS x, round(sqrt(i) * sin(i * (pi() * (3 - sqrt(5))) + radians(24301 % 360)), 5) + 0.0::DOUBLE AS y FROM (SELECT artist_id, row_number() OVER (ORDER BY artist_id) - 1 AS i FROM (SELECT DISTINCT artist_id FROM supplier_ways))")
def layout_spiral(t):
    return layout.spiral(layout.nodes(_supplier_edges(t))).select("artist_id", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query()
def layout_force(t):
    """Ten rounds; the number of rounds is the job's parameter, 300 by default."""
    return layout.run(_supplier_edges(t), iterations=10).select("artist_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("tags vocabulary genre_counts positions", """SELECT name, count(*) AS artists, round(stddev_samp(CAST(x AS DOUBLE)), 6) AS spread_x, round(stddev_samp(CAST(y AS DOUBLE)), 6) AS spread_y FROM genre_counts JOIN positions ON artist_id = artist
    WHERE releases > 1 GROUP BY name HAVING count(*) > 20 ORDER BY round(stddev_samp(CAST(x AS DOUBLE)), 6) + round(stddev_samp(CAST(y AS DOUBLE)), 6), name LIMIT 20""")
def genre_spread(t):
    counted = genres.counts(_tags(t), _customers(t), parts=canon.parts(t)).where("releases > 1").withColumnRenamed("artist", "artist_id").join(canon.positions(t), "artist_id")
    spread = lambda c: F.round(F.stddev_samp(F.col(c).cast("double")), 6).alias(f"spread_{c}")
    rows = counted.groupBy("name").agg(F.count(F.lit(1)).alias("artists"), spread("x"), spread("y")).where("artists > 20")
    return rows.orderBy(F.col("spread_x") + F.col("spread_y"), "name").limit(20)


@query("credits relations judged edges positions", """SELECT CASE WHEN score >= 0.5 THEN '1 >= 0.5' WHEN score >= 0.3 THEN '2 >= 0.3' ELSE '3 rest' END AS strength, count(*) AS edges,
    round(avg(sqrt(pow(CAST(p.x AS DOUBLE) - q.x, 2) + pow(CAST(p.y AS DOUBLE) - q.y, 2))), 6) AS distance FROM edges JOIN positions p ON p.artist_id = source_id JOIN positions q ON q.artist_id = target_id GROUP BY 1""")
def distance_by_strength(t):
    place = canon.positions(t).select("artist_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = layout.pair_distance(_edges(t), place)
    strength = F.when(F.col("score") >= 0.5, "1 >= 0.5").when(F.col("score") >= 0.3, "2 >= 0.3").otherwise("3 rest")
    return rows.groupBy(strength.alias("strength")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("distance"), 6).alias("distance"))


# Slice


def _kept(t: Tables) -> DataFrame:
    return slicing.kept(canon.positions(t), canon.weights(t), KEEP)


@query("positions weights kept", "SELECT artist_id FROM kept")
def slice_kept(t):
    return _kept(t)


@query("credits relations judged edges positions weights kept", "SELECT source_id, target_id FROM edges WHERE source_id IN (FROM kept) AND target_id IN (FROM kept)")
def slice_edges(t):
    return slicing.pruned(_edges(t).select("source_id", "target_id"), ["source_id", "target_id"], _kept(t))


@query("positions weights kept", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS artist_id FROM orders WHERE o_orderkey % 7 = 0 OR o_custkey IN (FROM kept)")
def slice_nullable_fk(t):
    groups = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("artist_id"))
    return slicing.pruned(groups, ["artist_id"], _kept(t))


@query("positions weights kept", """SELECT 'artist' AS "table", count(*) AS rows FROM customer WHERE c_custkey IN (FROM kept) UNION ALL SELECT 'artist_credit', count(*) FROM orders WHERE o_custkey IN (FROM kept)
    UNION ALL SELECT 'artist_position', count(*) FROM positions WHERE artist_id IN (FROM kept) UNION ALL SELECT 'label', 0""")
def slice_counts(t):
    whole = {"artist": canon.artists(t), "artist_credit": canon.credits(t), "artist_position": canon.positions(t), "label": canon.label_rows(t)}
    left = slicing.cut(whole, _kept(t))
    out = None
    for name in sorted(left):
        n = left[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
