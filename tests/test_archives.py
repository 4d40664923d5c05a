"""Dumps as they come: tar archives, multi-stream archives with an index, cut and odd records, limits and progress."""

import bz2
import gzip
import io
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from starloom import jobs, progress
from starloom.operators import facts, genres
from starloom.sources import archives, dumps, streams
from starloom.store import Canon


def tar(path, members, pack):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    path.write_bytes(pack(held.getvalue()))


def in_pieces(data):
    """As parallel packers write: several compressed streams in a row."""
    return b"".join(bz2.compress(data[i : i + 3000]) for i in range(0, len(data), 3000))


@pytest.mark.parametrize(("name", "pack"), [("a.tar.bz2", in_pieces), ("a.tar.gz", gzip.compress), ("a.tar", bytes)])
def test_members_as_lines(spark, tmp_path, name, pack):
    big = b"".join(b"%d\tx\n" % i for i in range(9000))
    tar(tmp_path / name, [("TIMESTAMP", b"2026-08-01 00:00\n"), ("mbdump/artist", big + b"\\.\nlate\n"), ("mbdump/area", b"1\tx\tLand"), ("other/artist", b"no\n")], pack)
    path = str(tmp_path / name)
    assert archives.timestamp(spark, path) == "2026-08-01 00:00"
    rows = archives.lines(spark, path, ["mbdump/*"], end_mark=True)
    assert {r.member: r["count"] for r in rows.groupBy("member").count().collect()} == {"mbdump/artist": 9000, "mbdump/area": 1}
    assert [r.value for r in rows.where("member = 'mbdump/artist'").orderBy("line").limit(2).collect()] == ["0\tx", "1\tx"]


def test_names_are_pushed_to_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = archives._Reader({"path": "x"})
    assert list(reader.pushFilters([EqualTo(("member",), "a"), GreaterThan(("line",), 3), In(("member",), ("a", "b"))])) == [GreaterThan(("line",), 3)]
    assert reader._wanted("a") and not reader._wanted("b")


def test_backbone_and_relations_from_archives(spark, tmp_path):
    mbid = "00000001-0000-0000-0000-000000000000"
    artist = "\t".join(["1", mbid, "One", "One", *[""] * 12, "t", "", ""]).encode()
    empty = [(f"mbdump/{t}", b"") for t in dumps.COPY_COLUMNS if t not in ("artist", "artist_credit_name")]
    tar(tmp_path / "x.tar.bz2", [("mbdump/artist", artist + b"\n\\.\n"), ("mbdump/artist_credit_name", b"10\t0\t1\n"), *empty], in_pieces)
    tar(tmp_path / "y.tar.bz2", [("a/relations.json", b'{"id_0":10,"id_1":99,"score":0.9}\n'), ("a/x.json", b"{}")], in_pieces)
    canon = Canon(spark, str(tmp_path / "canon"))
    jobs.import_backbone(canon, str(tmp_path / "x.tar.bz2"), "1")
    assert canon.read("artist").first().name == "One" and canon.read("artist_credit").count() == 1
    jobs.import_similarity(canon, str(tmp_path / "y.tar.bz2"), "1")
    assert canon.counters["relations"] == 1 and canon.counters["unknown"] == 1


PAGE = "<page><title>T{0}</title><ns>0</ns><id>1</id><revision><id>{0}</id><text bytes='1'>text of {0} &amp;amp; more</text></revision></page>\n"


@pytest.fixture
def archive(tmp_path):
    """Fifty streams of twenty pages each between a head and a tail; and their index."""
    parts, index, at = [bz2.compress(b"<mediawiki><siteinfo/>\n")], [], 0
    at = len(parts[0])
    for s in range(50):
        parts.append(bz2.compress("".join(PAGE.format(s * 20 + k) for k in range(20)).encode()))
        index += [f"{at}:{s * 20 + k}:T{s * 20 + k}" for k in range(20)]
        at += len(parts[-1])
    parts.append(bz2.compress(b"</mediawiki>"))
    (tmp_path / "pages.xml.bz2").write_bytes(b"".join(parts))
    (tmp_path / "index.txt.bz2").write_bytes(bz2.compress("\n".join(index).encode()))
    return tmp_path, [len(p) for p in parts]


def test_only_wanted_streams_are_read(spark, archive, monkeypatch):
    folder, sizes = archive
    wanted = spark.createDataFrame([("T45",), ("T47",), ("T990",), ("T400",), ("none",)], "title string")
    index = dumps.index(dumps.lines(spark, str(folder / "index.txt.bz2")))
    got = streams.pages(spark, str(folder / "pages.xml.bz2"), index, wanted)
    whole = dumps.pages(dumps.records(spark, str(folder / "pages.xml.bz2"), "page"))
    assert whole.count() == 1000
    assert sorted(map(str, got.join(wanted, "title").collect())) == sorted(map(str, whole.join(wanted, "title").collect()))
    assert got.count() == 60 and got.where("title = 'T45'").first().text == "text of 45 &amp; more"

    read = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            read.append((self.tell(), data := super().read(n)))
            return data

    file = Counted((folder / "pages.xml.bz2").read_bytes())
    for r in streams.ranges(index.coalesce(1)).join(dumps.wanted_streams(index, wanted), "offset").collect():
        streams.stream(file, r.offset, r.until)
    starts = [sum(sizes[: k + 1]) for k in (2, 20, 49)]
    assert sum(len(d) for _, d in read) <= sum(sizes[k + 1] for k in (2, 20)) + sizes[50] + sizes[51] and sorted({a for a, d in read if d}) == starts


def test_a_damaged_stream_gives_what_came_before(archive):
    folder, sizes = archive
    data = bytearray((folder / "pages.xml.bz2").read_bytes())
    data[sizes[0] + sizes[1] // 2] ^= 255
    assert streams.stream(io.BytesIO(bytes(data)), sizes[0], sizes[0] + sizes[1]) == b""
    assert b"T20<" in streams.stream(io.BytesIO(bytes(data)), sizes[0] + sizes[1], None)


def test_cut_and_odd_records(spark, tmp_path):
    text = (
        '<?xml version="1.0"?>\n<masters>\n<master id="1"><artists><artist><id> 7 </id><name>A &foo; &#243;</name></artist></artists><genres><genre>Rock &hellip; &amp; <![CDATA[<b>&amp;]]></genre></genres></master>\n'
        '<master id="2"/>\n<master id="3"><artists><artist><id>x</id></artist><artist><id>9</id></artist></artists><!-- <genre>no</genre> --><genres><genre>Jazz</genre></genres><styles><style>Bop</style></styles></master>\n'
        '<master id="4"><artists><artist><id>8</id></artist></artists><genres><genre>Pop</genre><genre>Ro'
    )
    for name, data in [("m.xml", text.encode()), ("m.xml.gz", gzip.compress(text.encode())), ("m.xml.bz2", bz2.compress(text.encode()))]:
        (tmp_path / name).write_bytes(data)
        got = dumps.masters(dumps.records(spark, str(tmp_path / name), "master")).where("size(artists) > 0").collect()
        assert sorted((r.artists, r.genres, r.styles) for r in got) == [([7], ["Rock &hellip; & <b>&amp;"], []), ([8], ["Pop"], []), ([9], ["Jazz"], ["Bop"])]
    label = '<labels><label><images/><id>5</id><name>N &unknown; &#x1F389;</name><sublabels><label id="6">S</label></sublabels><parentLabel id="4">P</parentLabel></label>\n<label><id>8</id><name>Cut</name><profile>is lo'
    (tmp_path / "l.xml").write_text(label)
    assert sorted(tuple(r) for r in dumps.labels(dumps.records(spark, str(tmp_path / "l.xml"), "label")).collect()) == [(5, "N &unknown; 🎉", None, 4), (8, "Cut", None, None)]
    artist = "<artists><artist><id>1</id><members><id>99</id><name id='99'>m</name></members></artist><artist><members><id>98</id></members><id>2</id></artist></artists>"
    (tmp_path / "a.xml").write_text(artist)
    assert sorted(r.artist for r in dumps.artist_ids(dumps.records(spark, str(tmp_path / "a.xml"), "artist")).collect()) == [1, 2]


@pytest.mark.parametrize("pack", [bytes, bz2.compress])
def test_records_across_many_splits(spark, tmp_path, pack):
    """Files cut into many tasks give each record once."""
    body = "".join(f'<master id="{i}"><artists><artist><id>{i}</id></artist></artists><genres><genre>{"g" * (i % 50)}x</genre></genres></master>\n' for i in range(30_000))
    (tmp_path / "m.xml.bz2" if pack is not bytes else tmp_path / "m.xml").write_bytes(pack(f"<masters>\n{body}</masters>".encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        tags = genres.tagged(dumps.masters(dumps.records(spark, str(tmp_path), "master")))
        found = tags.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("artist").alias("d"), F.sum(F.length("name")).alias("c")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tuple(found) == (30_000, 30_000, sum(i % 50 + 1 for i in range(30_000)))


def test_the_first_lines_are_the_same_each_time(spark, tmp_path):
    for name in "ba":
        (tmp_path / name).write_text("[\n" + "".join('{"id":"Q%s%d"},\n' % (name, i) for i in range(9000)) + "broken\n]\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for limit in (0, 1, 777, 8999, 9000, 9001, 12345, 18000, 99999):
            got = [r.id for r in facts.entities(dumps.first_lines(spark, str(tmp_path), limit, facts.is_entity)).collect()]
            assert sorted(got) == sorted([f"Qa{i}" for i in range(9000)] + [f"Qb{i}" for i in range(9000)])[:0] + sorted(([f"Qa{i}" for i in range(9000)] + [f"Qb{i}" for i in range(9000)])[:limit])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_progress_is_told_before_the_job_ends(spark):
    told, wait = [], F.udf(lambda i: time.sleep(0.3) or i, "bigint")
    with progress.told(spark, lambda done, total: told.append((time.time(), done, total)), seconds=0.05):
        spark.range(0, 12, 1, 12).select(wait("id").alias("i")).write.format("noop").mode("overwrite").save()
        ended = time.time()
    assert len([t for t, done, _ in told if t < ended and done < 12]) >= 2 and all(total == 12 for _, _, total in told)
    with progress.told(spark, None):
        assert spark.range(3).count() == 3
