"""The jobs end to end on a small dump."""

import pytest

from starloom import __main__, jobs
from starloom.config import Config
from starloom.operators import slicing
from starloom.store import Canon

MBID = "0000000{}-0000-0000-0000-000000000000"


@pytest.fixture(scope="module")
def canon(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    artist = lambda i, name: "\t".join([str(i), MBID.format(i), name, name, "1980", "", "", "\\N", "", "", "1", "", "", "", "", "", "t", "", ""])
    tables = {
        "artist": [artist(1, "One"), artist(2, "Two"), artist(3, "Three"), artist(4, "Four"), "5\tbad uuid\tx\tx"],
        "artist_type": ["1\tGroup"], "release_group_primary_type": ["1\tAlbum"], "area": ["1\tx\tLand"], "iso_3166_1": ["1\tLA"],
        "release": ["10\t\t\t\t500", "11\t\t\t\t500"], "release_country": ["10\t81\t2004\t2\t7"], "release_unknown_country": ["11\t1977\t8\t30"],
        "release_group": [f"500\t{MBID.format(9)}\tRecord\t20\t1"], "artist_credit_name": ["10\t0\t1", "20\t0\t2", "20\t1\t1", "30\t0\t3", "40\t0\t4"],
        "url": ["1\tx\thttps://d/artist/77-One"], "link": ["1\t5"], "link_type": ["5\t\t\t\tartist\turl\tdiscogs"], "l_artist_url": ["1\t1\t1\t1"],
    }
    for name, lines in tables.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    (folder / "relations.json").write_text('{"id_0":10,"id_1":20,"score":0.9}\n{"id_0":20,"id_1":30,"score":0.5}\nbroken\n{"id_0":30,"id_1":40,"score":0.4}\n{"id_0":10,"id_1":40,"score":0.01}\n')
    (folder / "masters.xml").write_text("<masters><master><artists><artist><id>77</id></artist></artists><genres><genre>Rock</genre></genres></master></masters>")
    (folder / "facts.json").write_text('[\n{"id":"Q1","labels":{"en":{"value":"One"}},"claims":{"P434":[{"mainsnak":{"datavalue":{"value":"%s"}}}]},"sitelinks":{"enwiki":{"title":"One (band) & co"}}},\n]\n' % MBID.format(1))
    page = "<page><title>{}</title><ns>0</ns><id>7</id><revision><id>12345</id><text bytes='9' xml:space='preserve'>{}</text></revision></page>"
    text = "'''One''' are a band from [[Land]] with a very long history of records.&lt;ref&gt;x&lt;/ref&gt;"
    (folder / "pages.xml").write_text("<mediawiki>" + page.format("One (band) &amp; co", text) + page.format("One", "other") + "</mediawiki>")
    canon = Canon(spark, str(tmp_path_factory.mktemp("canon")))
    with pytest.raises(ValueError):
        jobs.import_similarity(canon, str(folder / "relations.json"), "1")
    jobs.import_backbone(canon, str(folder), "1")
    assert canon.counters == {"release_groups": 1, "kept": 1}
    jobs.import_similarity(canon, str(folder / "relations.json"), "1", least=0.1)
    assert canon.counters == {"relations": 4, "weak": 1, "unknown": 0, "self": 0, "kept": 3}
    jobs.import_genres(canon, str(folder / "masters.xml"), "1")
    assert canon.counters == {"tags": 1, "credited": 1}
    jobs.import_facts(canon, str(folder / "facts.json"))
    assert canon.counters == {"read": 1, "with_artist_id": 1, "kept": 1}
    with pytest.raises(ValueError):
        jobs.import_prose(canon, str(folder / "pages.xml"), "1", limit=0)
    jobs.import_prose(canon, str(folder / "pages.xml"), "1", limit=5)
    assert canon.counters == {"wanted": 1, "found": 1, "without_lead": 0}
    jobs.make_layout(canon, iterations=3, tiles_dir=str(folder / "sky"))
    assert (folder / "sky" / "tiles").exists()
    return canon


def test_imports(canon):
    assert {r.id: (r.name, r.kind, r.begin_year, r.ended) for r in canon.read("artist").collect()}[1] == ("One", "Group", 1980, True)
    assert [tuple(r) for r in canon.read("release_group").select("primary_type", "artist_id", "year").collect()] == [("Album", 2, 1977)]
    assert canon.read("artist_prominence").where("artist_id = 2").first().degree == 2
    assert [tuple(r) for r in canon.read("artist_genre").collect()] == [(1, 1, 1)]
    assert canon.read("artist_wikidata").first().qid == 1
    prose = canon.read("artist_prose").first()
    assert prose.extract == "One are a band from Land with a very long history of records." and prose.revision_id == 12345
    assert prose.source_url.endswith("/One_(band)_&_co") and prose.extract_chars < prose.source_chars


def test_card_and_search(canon):
    one = jobs.card(canon, 1).first()
    assert one.name == "One" and one.position.brightness > 0 and [g.name for g in one.genres] == ["Rock"] and [s.name for s in one.similar] == ["Two"]
    assert jobs.card(canon, 99).count() == 0
    assert [r.name for r in jobs.search(canon, "t").collect()] == [] and [r.name for r in jobs.search(canon, "tw").collect()] == ["Two"]


def test_tiles_and_slice(canon, tmp_path):
    assert jobs.write_tiles(canon, str(tmp_path), level0=4) == 1
    with pytest.raises(ValueError):
        jobs.slice_canon(canon, 4)
    assert jobs.slice_canon(canon, 2, dry_run=True) == 2 and canon.read("artist").count() == 4
    jobs.slice_canon(canon, 2)
    names = [n for n in canon.manifest() if n != "dump_import"]
    assert canon.read("artist").count() == 2 and slicing.faults({n: canon.read(n) for n in names}).count() == 0


def test_command_line_and_config():
    args = __main__.parser().parse_args(["slice"])
    assert args.keep == 100_000 and not args.dry_run
    assert __main__.parser().parse_args(["import", "facts", "--dump", "x", "--limit", "5"]).limit == 5
    assert __main__.parser().parse_args(["layout", "--reach", "3", "--tiles", "y"]).reach == 3
    assert __main__.parser().parse_args(["layout"]).seed == 24301
    assert Config.from_env({"STARLOOM_CANON": " "}) == Config() and Config.from_env({"STARLOOM_CANON": "/x"}).canon_root == "/x"
