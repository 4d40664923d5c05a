"""The canon's tables: columns, keys and references, as data that jobs and checks share."""

from __future__ import annotations

#: table -> (columns as DDL, key)
TABLES: dict[str, tuple[str, list[str]]] = {
    "dump_import": ("id int, source string, version string, started_at timestamp, finished_at timestamp, rows_imported bigint", ["source", "version"]),
    "artist": ("id int, mbid string, name string, sort_name string, kind string, area string, area_code string, begin_year smallint, end_year smallint, ended boolean, comment string", ["id"]),
    "release_group": ("id int, mbid string, name string, primary_type string, artist_id int, year smallint", ["id"]),
    "artist_url": ("artist_id int, kind string, url string", ["artist_id", "kind", "url"]),
    "similarity_metric": ("id smallint, key string, description string", ["id"]),
    "artist_similarity": ("metric_id smallint, source_id int, target_id int, score float", ["metric_id", "source_id", "target_id"]),
    "artist_prominence": ("metric_id smallint, artist_id int, degree int, weight float", ["metric_id", "artist_id"]),
    "artist_credit": ("id int, artist_id int", ["id"]),
    "artist_discogs": ("artist_id int, discogs_id int", ["artist_id"]),
    "genre": ("id int, name string, is_style boolean", ["id"]),
    "artist_genre": ("artist_id int, genre_id int, releases int", ["artist_id", "genre_id"]),
    "label": ("id int, name string, profile string, parent_label_id int", ["id"]),
    "artist_wikidata": ("artist_id int, qid int, enwiki_title string", ["artist_id"]),
    "wikidata_item": ("qid int, label string", ["qid"]),
    "artist_fact": ("artist_id int, origin_qid int, origin_is_birth boolean, inception_year smallint, country_qid int", ["artist_id"]),
    "artist_wikidata_genre": ("artist_id int, genre_qid int", ["artist_id", "genre_qid"]),
    "artist_wikidata_label": ("artist_id int, label_qid int", ["artist_id", "label_qid"]),
    "artist_influence": ("artist_id int, influence_id int", ["artist_id", "influence_id"]),
    "artist_prose": ("artist_id int, extract string, source_title string, source_url string, licence string, dump_version string, revision_id bigint, source_chars int, extract_chars int", ["artist_id"]),
    "sky_layout": ("id smallint, key string, metric_id smallint, description string, seed bigint, created_at timestamp, stars int", ["id"]),
    "artist_position": ("layout_id smallint, artist_id int, x float, y float", ["layout_id", "artist_id"]),
}

#: (table, column) pairs that refer to artist and go with it; the slice and the integrity check go through them.
FK_TO_ARTIST: list[tuple[str, str]] = [
    ("release_group", "artist_id"),
    ("artist_url", "artist_id"),
    ("artist_similarity", "source_id"),
    ("artist_similarity", "target_id"),
    ("artist_prominence", "artist_id"),
    ("artist_credit", "artist_id"),
    ("artist_discogs", "artist_id"),
    ("artist_genre", "artist_id"),
    ("artist_wikidata", "artist_id"),
    ("artist_fact", "artist_id"),
    ("artist_wikidata_genre", "artist_id"),
    ("artist_wikidata_label", "artist_id"),
    ("artist_influence", "artist_id"),
    ("artist_influence", "influence_id"),
    ("artist_prose", "artist_id"),
    ("artist_position", "artist_id"),
]

#: Tables kept in a folder for each value of a column, so that a job replaces its own value's rows alone.
PARTS: dict[str, str] = {"artist_similarity": "metric_id", "artist_prominence": "metric_id", "artist_position": "layout_id"}

#: Columns that a table is sorted by, a copy for each: what asks for one value of them reads few row groups.
ORDERS: dict[str, list[str]] = {
    "artist": ["id"],
    "artist_similarity": ["source_id", "target_id"],
    "artist_prominence": ["artist_id"],
    "artist_position": ["artist_id"],
    "artist_genre": ["artist_id"],
    "artist_url": ["artist_id"],
    "artist_prose": ["artist_id"],
    "genre": ["id"],
}

#: Conditions that every row of a table meets.
CHECKS: dict[str, str] = {
    "artist_similarity": "source_id < target_id",
    "artist_influence": "artist_id <> influence_id",
    "artist_fact": "(origin_qid IS NULL) = (origin_is_birth IS NULL)",
}
