import pytest
from pyspark.sql import functions as F

from starloom.functions import markup, parsing
from starloom.operators import facts, genres
from starloom.sources import dumps


@pytest.mark.parametrize(
    ("line", "fields"),
    [
        ("1\tQueen\tGroup", ["1", "Queen", "Group"]),
        ("1\t\\N\tx", ["1", None, "x"]),
        ("1\ta\\tb\\nc", ["1", "a\tb\nc"]),
        ("AC\\\\DC", ["AC\\DC"]),
        ("Queen\tN", ["Queen", "N"]),
        ("\t\\N", ["", None]),
        ("naïve\tмир", ["naïve", "мир"]),
        ("a\tb\r", ["a", "b"]),
        ("a\\\\tb", ["a\\tb"]),
        ("tail\\", ["tail\\"]),
        ("\\x", ["x"]),
    ],
)
def test_copy_fields(spark, line, fields):
    assert spark.createDataFrame([(line,)], "v string").select(parsing.copy_fields(F.col("v"))).first()[0] == fields


def test_copy_table(spark):
    rows = spark.createDataFrame([("31\t84\t1968\t11\t2",), ("x\t1\t40000",), (" 7 \t1\t\\N",), ("\\.",)], "value string")
    assert [tuple(r) for r in dumps.copy_table(rows, "release_country").collect()] == [(31, 1968), (None, None), (None, None)]


def test_nothing_follows_the_end_of_a_copy(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{i}\tx\n" for i in range(9000)) + "\\.\n1\tlate\n\\.\n2\tlater\n")
    (tmp_path / "b").write_bytes(b"7\ty\r\n\\.\r\n8\tz\r\n")
    (tmp_path / "c").write_text("5\tw\n\\.x\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [r.value.rstrip("\r") for r in dumps.copy_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted([*(f"{i}\tx" for i in range(9000)), "7\ty", "5\tw", "\\.x"])


def test_lines_of_a_copy_are_not_shuffled(spark, tmp_path, capsys):
    (tmp_path / "a").write_text("1\tx\n\\.\n")
    dumps.copy_lines(spark, str(tmp_path)).explain("formatted")
    assert "Exchange" not in capsys.readouterr().out


def test_relations(spark):
    rows = spark.createDataFrame([("not json",), ('{"id_0":1,"id_1":2,"score":0.5,"more":1}',), ("",), ('{"id_0":1}',)], "value string")
    assert [tuple(r) for r in dumps.relations(rows).collect()] == [(1, 2, 0.5)]


def test_urls_and_versions(spark):
    urls = ["http://x/artist/111-Name", "http://x/artist/none/artist/5", "http://x/label/7", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(parsing.id_after(F.col("u"), "/artist/")).collect()] == [111, None, None, None]
    names = spark.createDataFrame([("dump_20260801_m.gz",), ("dump_2026.gz",), ("dump_202608011.gz",)], "n string")
    assert [r[0] for r in names.select(parsing.file_version(F.col("n"), "dump_")).collect()] == ["20260801", None, None]


def test_xml_masters(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<masters><master id="1"><artists><artist><id>7</id><name>A</name></artist><artist><id>8</id></artist></artists><genres><genre>Rock</genre></genres><styles><style>Rock &amp; Roll</style></styles></master>'
        '<master id="2"><artists><artist><id>7</id></artist></artists></master></masters>'
    )
    rows = dumps.masters(dumps.records(spark, str(tmp_path / "m.xml"), "master"))
    got = sorted(tuple(r) for r in genres.tagged(rows).collect())
    assert got == [(7, "Rock", False), (7, "Rock & Roll", True), (8, "Rock", False), (8, "Rock & Roll", True)]


def test_xml_labels(spark, tmp_path):
    (tmp_path / "l.xml").write_text('<labels><label><id>5</id><name>N</name><parentLabel id="4">P</parentLabel><sublabels><label id="6">S</label></sublabels></label></labels>')
    assert [tuple(r) for r in dumps.labels(dumps.records(spark, str(tmp_path / "l.xml"), "label")).collect()] == [(5, "N", None, 4)]


ENTITY = '{"id":"Q%d","labels":{"en":{"value":"L%d"}},"claims":{%s},"sitelinks":{"enwiki":{"title":"T"}}},'
MBID = '"P434":[{"mainsnak":{"datavalue":{"value":"%s"}}}]'
ITEM = '"%s":[{"mainsnak":{"datavalue":{"value":{"id":"Q%d"}}}}]'


def test_entities(spark):
    lines = [
        "[",
        ENTITY % (1, 1, ",".join([MBID % "a", ITEM % ("P740", 90), ITEM % ("P19", 91), '"P571":[{"mainsnak":{"datavalue":{"value":{"time":"+1987-01-01T00:00:00Z"}}}}]'])),
        ENTITY % (2, 2, ",".join([MBID % "b", ITEM % ("P19", 91), '"P571":[{"mainsnak":{}}]', ITEM % ("P737", 1)])),
        ENTITY % (3, 3, MBID % "stranger"),
        '{"id":"L5","claims":{}}',
        "broken",
        "]",
        "",
    ]
    found = facts.entities(spark.createDataFrame([(x,) for x in lines], "value string"))
    slim = facts.slim(found)
    assert slim.schema == found.schema and {r.id: r.claims is None for r in slim.collect()} == {"Q1": False, "Q2": False, "Q3": False, "L5": True}
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id int, mbid string")
    rows = facts.facts(found, known)
    got = {r.artist_id: (r.qid, r.origin_qid, r.origin_is_birth, r.inception_year) for r in rows.collect()}
    assert got == {1: (1, 90, False, 1987), 2: (2, 91, True, None)}
    assert [tuple(r) for r in facts.influences(rows).collect()] == [(2, 1)]
    assert sorted(map(str, facts.facts(slim, known).collect())) == sorted(map(str, rows.collect())) and tuple(facts.counted(slim, rows).first()) == (4, 3, 2)
    assert {r.qid: r.label for r in facts.referenced_items(rows, found).collect()} == {90: None, 91: None}


LEADS = [
    ("#REDIRECT [[X]]", None),
    ("", None),
    ("'''Queen''' are a [[rock music|rock]] band formed in London in 1970, by four students.\n== History ==\nMore.", "Queen are a rock band formed in London in 1970, by four students."),
    ("{{Infobox|a={{b|c}}|d=e}}\nThe group was a long running ensemble from the north of England.", "The group was a long running ensemble from the north of England."),
    ("The town was active{{spaced ndash}}and loud (; born 1982) for {{convert|10|km|mi}} around the hills.<ref name=x>no</ref>", "The town was active – and loud (born 1982) for 10 km around the hills."),
    ("Someone ({{lang|de|nichts}}) wrote songs<!-- hidden --> for a very long time [[File:a.jpg|thumb|a [[b]] c]] indeed.", "Someone (nichts) wrote songs for a very long time indeed."),
    ("* list item that is long enough to be kept if it were not a list\nA first paragraph that is long enough to be kept.\n\nA second paragraph, which is also long enough.", "A first paragraph that is long enough to be kept.\n\nA second paragraph, which is also long enough."),
    ("Nothing at all is said about what comes after this {{mark that nobody has ever closed", "Nothing at all is said about what comes after this"),
    ("A <span <b>of</b> x>word</span> that has a tag inside a tag, and then goes on < with the rest lost", "A word that has a tag inside a tag, and then goes on"),
    ("An image [[File:x.jpg|thumb|of [[a|one [[b]] two]] and [c] more]] stands in the middle of this sentence.", "An image stands in the middle of this sentence."),
    ("A value of 5 > 3 stands here, and an arrow -> as well, for a good while.", "A value of 5 > 3 stands here, and an arrow -> as well, for a good while."),
    ("They wrote [[Song [live]|the song [live] here]] and [[a|b|c [d]]] too, in a single week of May.", "They wrote the song [live] here and c [d] too, in a single week of May."),
    ("They wrote one song that is well known and loved [[and one link that nobody closes", "They wrote one song that is well known and loved"),
    ("The first café was opened by two of them&nbsp;in [[Zürich|the city of Zürich]] & then another.", "The first café was opened by two of them in the city of Zürich & then another."),
]


@pytest.mark.parametrize(("text", "lead"), LEADS)
def test_lead(spark, text, lead):
    assert spark.createDataFrame([(text,)], "t string").select(markup.lead(F.col("t"))).first()[0] == lead


BAND = "The band was formed in London in 1970 and went on to play for many years."
BRACES = [
    ("{{Infobox|a=<math>a_{1}</math>|b=x}}\n" + BAND, BAND),
    ("{{Infobox|a={| class=x\n| y\n|}|b=c}}\n" + BAND, BAND),
    ("{{a|" * 9 + "x" + "}}" * 9 + BAND, BAND),
    ("{{nowrap|" * 9 + BAND + "}}" * 9, BAND),
    ("A set {x} of }} marks {{b|{c} }} is kept as it is written here, {{lang|de|[[a|b]] {d} }}.", "A set {x} of }} marks is kept as it is written here, b {d}."),
    (BAND + " {{unclosed|{{closed|{x}}} and more", BAND),
]


@pytest.mark.parametrize(("text", "lead"), BRACES)
def test_lead_counts_braces(spark, text, lead):
    assert spark.createDataFrame([(text,)], "t string").select(markup.lead(F.col("t"))).first()[0] == lead


NAMES = {"nbsp": " ", "ndash": "–", "mdash": "—", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decoded(text):
    """Character by character, as far as the twelfth of a reference."""
    out, i = "", 0
    while i < len(text):
        end = text.find(";", i, i + 12) if text[i] == "&" else -1
        char = NAMES.get(text[i + 1 : end]) if end > 0 else None
        if end > 0 and text[i + 1 : i + 2] == "#":
            digits, base = (text[i + 3 : end], 16) if text[i + 2] in "xX" else (text[i + 2 : end], 10)
            if digits and set(digits) <= set("0123456789abcdefABCDEF"[: 10 if base == 10 else 22]):
                code = int(digits, base)
                char = chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None
        out, i = (out + char, end + 1) if char is not None else (out + text[i], i + 1)
    return out


def test_entities_are_decoded(spark):
    texts = ["1970&#8211;1980 a &#124; b caf&#xE9; &#XE9; &#39;x&#39;", "&amp;#8211; &#38;lt; &amp;lt; &&amp;&", "&#xD800; &#x110000; &#99999999; &#; &#x; &#xg; &#8211 &copy; &nbsp", "&#000000065; &#0000000065; &#x1F389;", "&nbsp;&ndash;&mdash;&lt;&gt;&quot;&apos;&amp;", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", markup.decode_entities(F.col("t")).alias("d"), markup.page_text(F.col("t")).alias("p")).collect()
    assert {r.i: r.d for r in rows} == {i: None if t is None else decoded(t) for i, t in enumerate(texts)}
    assert [r.p for r in rows][0] == "1970–1980 a | b café é 'x'"
    prose = spark.createDataFrame([(BAND + " It split in 1970&#8211;1980.",)], "t string").select(markup.lead(F.col("t")))
    assert prose.first()[0] == BAND + " It split in 1970–1980."


def test_index(spark):
    rows = spark.createDataFrame([("5:1:A: B",), ("5:2:C",), ("9:3:D",), ("bad",)], "value string")
    found = dumps.wanted_streams(dumps.index(rows), spark.createDataFrame([("A: B",), ("C",)], "title string"))
    assert [tuple(r) for r in found.collect()] == [(5, ["A: B", "C"])]
