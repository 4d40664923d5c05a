import math

import pytest
from pyspark.sql import functions as F

from starloom import store
from starloom.operators import layout, serve, similarity, slicing, tiles
from starloom.sources import tilefiles
from starloom.staging import ranked
from starloom.streaming.imports import import_batches


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_id int, target_id int, score double")


def test_resolution(spark):
    credits = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "id int, artist_id int")
    rows = spark.createDataFrame([(10, 20, 0.2), (20, 11, 0.7), (10, 11, 0.9), (10, 9999, 0.9), (20, 30, 0.05)], "id_0 int, id_1 int, score float")
    assert {r.outcome: r["count"] for r in similarity.judged(rows, credits, 0.1).groupBy("outcome").count().collect()} == {"kept": 2, "self": 1, "unknown": 1, "weak": 1}
    assert [(r.source_id, r.target_id, round(r.score, 3)) for r in similarity.edges(rows, credits, 0.1).collect()] == [(1, 2, 0.7)]


def test_ranked_without_one_task(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    rows = ranked(df, F.desc("k"), F.asc("id")).collect()
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert {r.id: r["rank"] for r in rows} == {i: n for n, (_, i) in enumerate(want, 1)}


@pytest.mark.parametrize(("reach", "error"), [(1, 0.1), (3, 0.02)])
def test_repulsion_is_near_the_sum_over_pairs(spark, reach, error):
    import random

    r = random.Random(1)
    stars = [(i, r.uniform(-10, 10), r.uniform(-10, 10), r.uniform(0.5, 2)) for i in range(300)]
    stars += [(900 + i, r.gauss(4, 0.01), r.gauss(4, 0.01), 1.0) for i in range(60)] + [(999, 5000.0, 8000.0, 1.0)]  # a dense spot, and one far away
    df = spark.createDataFrame(stars, "artist_id int, x double, y double, mass double")
    got = {x.artist_id: (x.fx, x.fy) for x in layout.repulsion(df, reach).collect()}
    assert layout.fitting_depth(df) > 10
    worst = 0.0
    for i, x, y, _ in stars:
        fx = fy = 0.0
        for j, u, v, m in stars:
            if i != j:
                push = m / max((u - x) ** 2 + (v - y) ** 2, 0.01)
                fx, fy = fx - (u - x) * push, fy - (v - y) * push
        worst += math.hypot(got[i][0] - fx, got[i][1] - fy) / max(math.hypot(fx, fy), 5)
    assert worst / len(stars) < error


def test_movement_settles(spark):
    ring = [(i, (i + 1) % 12, 1.0) for i in range(12)]
    steps = []
    layout.run(edges(spark, [(min(a, b), max(a, b), w) for a, b, w in ring]), iterations=14, movement=steps)
    assert len(steps) == 14 and sum(steps[-3:]) < sum(steps[:3])


def test_levels_and_names():
    assert [tiles.level_for(s) for s in (2.0, 1.0, 0.5, 0.3, 0.01, 0.0)] == [0, 0, 1, 2, 6, 6]
    assert slicing.is_plain_identifier("artist_url") and not any(map(slicing.is_plain_identifier, ("", "1a", "a b", "A", "a" * 64, "a;drop")))


def test_layout_draws_the_connected_together(spark):
    e = edges(spark, [(1, 2, 1.0), (3, 4, 1.0), (1, 3, 0.02)])
    place = {r.artist_id: (r.x, r.y) for r in layout.run(e, iterations=12).collect()}
    d = lambda a, b: math.dist(place[a], place[b])
    assert d(1, 2) < d(1, 4) and d(3, 4) < d(2, 3)
    assert place == {r.artist_id: (r.x, r.y) for r in layout.run(e, iterations=12).collect()}
    assert layout.run(edges(spark, []), iterations=2).count() == 0


def test_tiles(spark):
    stars = spark.createDataFrame([(i, float(i), float(-i), 1.0 / (i + 1)) for i in range(30)], "artist_id int, x float, y float, brightness float")
    cut = tiles.pyramid(stars, level0=4, most=6)
    assert {r.level: r["count"] for r in cut.groupBy("level").count().collect()} == {0: 4, 1: 16, 2: 30}
    files = {r.path: bytes(r.content) for r in tiles.files(cut).collect()}
    assert len(files["0/0/0.bin"]) == 16 + 16 * 4 and files["0/0/0.bin"][:12] == b"LYST\x01\x00\x00\x00\x04\x00\x00\x00"
    assert [int(x) for x in tiles.decode(files["0/0/0.bin"])["id"]] == [0, 1, 2, 3]
    parts = {}
    for r in sorted(tiles.files(cut, part_stars=3).collect(), key=lambda r: (r.path, r.part)):
        assert r.stars <= 3
        parts[r.path] = parts.get(r.path, b"") + bytes(r.content)
    assert parts == files
    with pytest.raises(ValueError):
        tiles.decode(b"none")
    assert tiles.pyramid(stars.where("false")).count() == 0


def test_tile_files(spark, tmp_path):
    """Paths and bytes are those of the rows; a failed task leaves nothing; a second run replaces its own files."""
    stars = spark.createDataFrame([(i, float(i), float(-i), 1.0 / (i + 1)) for i in range(30)], "artist_id int, x float, y float, brightness float")
    rows = tiles.files(tiles.pyramid(stars, level0=4, most=6), part_stars=3)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.part)):
        want[r.path] = want.get(r.path, b"") + bytes(r.content)
    found = lambda: {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()}
    broken = rows.withColumn("content", F.when(F.col("path").startswith("0/"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        tilefiles.write(broken, str(tmp_path))
    assert found() == {} and not list(tmp_path.iterdir())
    for _ in range(2):
        tilefiles.write(rows, str(tmp_path))
        assert found() == want


def test_search_terms(spark):
    artists = spark.createDataFrame([(1, "Beatless"), (2, "The Beatles"), (3, "beatles")], "id int, name string")
    place = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "artist_id int, x float, y float")
    weights = spark.createDataFrame([(2, 9.0)], "artist_id int, weight double")
    assert [r.id for r in serve.search(artists, place, weights, " beatles ").collect()] == [3, 2, 1]
    assert serve.search(artists, place, weights, "b").count() == 0


def test_slice(spark):
    place = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)], "artist_id int, x float, y float")
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0)], "artist_id int, weight double")
    keep = slicing.kept(place, weights, 2)
    assert sorted(r.artist_id for r in keep.collect()) == [1, 2]
    groups = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id int, artist_id int")
    assert sorted(r.id for r in slicing.pruned(groups, ["artist_id"], keep).collect()) == [1, 3]
    with pytest.raises(ValueError):
        slicing.kept(place, weights, 0)
    whole = {"artist": spark.createDataFrame([(1,), (1,)], "id int"), "artist_influence": spark.createDataFrame([(1, 1), (1, 9)], "artist_id int, influence_id int")}
    found = {(r.table, r.fault): r.rows for r in slicing.faults(whole).collect()}
    assert found == {("artist", "repeated key"): 1, ("artist_influence", "dangling influence_id"): 1, ("artist_influence", "artist_id <> influence_id"): 1}


def test_store(spark, tmp_path):
    canon = store.Canon(spark, str(tmp_path / "canon"))
    assert canon.read("artist").count() == 0
    labels = spark.createDataFrame([(1, "a", None, None)], "id int, name string, profile string, parent_label_id int")
    canon.replace({"label": labels}, "labels", "1")
    canon.replace({"artist_prose": spark.createDataFrame([(1,)], "artist_id int")}, "prose", "1")
    assert canon.read("label").count() == 1 and canon.imported("labels", "1")
    canon.replace({"artist": spark.createDataFrame([(5,)], "id int")}, "backbone", "2", emptied=["*"])
    assert canon.read("artist_prose").count() == 0 and canon.read("label").count() == 1
    canon.replace({"label": labels.unionByName(labels)}, "labels", "1")
    assert [f.name for f in (tmp_path / "canon").iterdir() if f.suffix == ".draft"] == []
    ledger = canon.read("dump_import")
    assert ledger.count() == 3 and ledger.where("source = 'labels'").first().rows_imported == 2


def test_streamed_import_happens_once(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(str(tmp_path / "in"))
    canon = store.Canon(spark, str(tmp_path / "canon"))
    for _ in range(2):
        stream = spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in"))
        import_batches(stream, canon, "stream", lambda b: {"label": b}, str(tmp_path / "state")).awaitTermination()
    assert canon.read("label").count() == 1 and canon.read("dump_import").count() == 1


def test_layout_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = edges(spark, [(i, i + 1, 0.5) for i in range(50)])
    assert layout.run(e.mapInArrow(counted, e.schema), iterations=2).count() == 51
    assert read.value == 50
