"""The canon under concurrent imports, crashes and vacuum; parts and orders of its tables."""

import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from starloom import jobs, store
from starloom.schema import TABLES


@pytest.fixture
def canon(spark, tmp_path):
    return store.Canon(spark, str(tmp_path / "canon"))


def rows(spark, table, *values):
    return spark.createDataFrame(list(values), TABLES[table][0])


def edges(spark, metric, *values):
    return rows(spark, "artist_similarity", *((metric, a, b, s) for a, b, s in values))


def test_imports_at_once_both_survive(spark, canon):
    gate, failed = threading.Barrier(2), []

    def job(name, table, value):
        def build(at):
            gate.wait(60) if at.number == 0 else None  # both start from the empty canon
            return {table: value}

        try:
            canon.update(name, "1", build)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    values = [("labels", "label", rows(spark, "label", (1, "a", None, None))), ("prose", "artist_wikidata", rows(spark, "artist_wikidata", (1, 5, "t")))]
    threads = [threading.Thread(target=job, args=v) for v in values]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and canon.read("label").count() == 1 and canon.read("artist_wikidata").count() == 1
    assert sorted((r.id, r.source) for r in canon.read("dump_import").collect()) in ([(1, "labels"), (2, "prose")], [(1, "prose"), (2, "labels")])
    assert canon._numbers() == [1, 2]


def test_what_was_read_and_changed_is_built_anew(spark, canon):
    canon.replace({"genre": rows(spark, "genre", (1, "a", False))}, "genres", "1")
    seen = []

    def build(at):
        seen.append(at.read("genre").count())
        if len(seen) == 1:  # another import comes in between
            canon.replace({"genre": rows(spark, "genre", (1, "a", False), (2, "b", False))}, "genres", "2")
            canon.replace({"label": rows(spark, "label", (1, "a", None, None))}, "labels", "1")
        return {"artist_genre": rows(spark, "artist_genre", (1, seen[-1], 1))}

    canon.update("counts", "1", build)
    assert seen == [1, 2] and canon.read("artist_genre").first().genre_id == 2 and canon.read("label").count() == 1

    def never(at):
        at.read("genre")
        canon.replace({"genre": rows(spark, "genre", (1, "a", False))}, "genres", "3")
        return {}

    with pytest.raises(store.Conflict):
        canon.update("counts", "2", never)
    assert not canon.imported("counts", "2")


def test_a_crash_at_any_step_leaves_the_old_canon(spark, canon, monkeypatch):
    canon.replace({"label": rows(spark, "label", (1, "a", None, None))}, "labels", "1")
    for step in ("_written", "_entered", "_create"):
        with monkeypatch.context() as m:
            own = getattr(canon, step)

            def broken(*a, own=own, step=step):
                if step != "_create":
                    own(*a)
                raise RuntimeError("crash")

            m.setattr(canon, step, broken)
            with pytest.raises(RuntimeError):
                canon.replace({"label": rows(spark, "label", (1, "a", None, None), (2, "b", None, None))}, "labels", "2")
        assert canon.read("label").count() == 1 and not canon.imported("labels", "2") and canon._numbers() == [1]


def test_vacuum_keeps_what_live_manifests_name(spark, canon):
    for i in range(5):
        canon.replace({"label": rows(spark, "label", (i, "a", None, None))}, "labels", str(i))
    old = canon.snapshot()
    before = {n for n, _ in canon._listed("data")}
    assert canon.vacuum(keep=2) == [] and {n for n, _ in canon._listed("data")} == before  # all young
    gone = canon.vacuum(keep=2, grace_hours=-1)
    assert len(gone) == 6 and canon._numbers() == [4, 5]
    assert canon.read("label").first().id == 4 and old.read("label").first().id == 4 and canon.read("dump_import").count() == 5


def test_a_metric_replaces_its_own_part_alone(spark, canon):
    canon.replace({("artist_similarity", m): edges(spark, m, (1, 2, 0.5), (2, 3, 0.25)) for m in (1, 2)}, "similarity", "1")
    first = canon.manifest()["artist_similarity"]["1"]
    canon.replace({("artist_similarity", 2): edges(spark, 2, (5, 6, 1.0))}, "similarity", "2")
    assert canon.manifest()["artist_similarity"]["1"] == first and canon.read("artist_similarity").count() == 3
    assert canon.read("artist_similarity", 2).count() == 1 and canon.read("artist_similarity", 9).count() == 0
    with pytest.raises(ValueError):
        canon.replace({"artist_similarity": edges(spark, 1, (1, 2, 0.5))}, "similarity", "3")


def test_a_card_reads_few_row_groups(spark, canon, monkeypatch):
    """40,000 stars and 80,000 edges in small row groups: those that may hold one artist are a few of many."""
    monkeypatch.setattr(store, "ROW_GROUP", 16 << 10)
    n = 40_000
    artist = spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in TABLES["artist"][0].split(", ")[1:]) if c != "name"), F.concat(F.lit("n"), "id").alias("name"))
    names = [c.split()[0] for c in TABLES["artist"][0].split(", ")]
    far = spark.range(1, n + 1).select(F.lit(1).cast("smallint").alias("metric_id"), F.col("id").cast("int").alias("source_id"), F.explode(F.array((F.col("id") + 7).cast("int"), (F.col("id") * 3 % n + n + 10).cast("int"))).alias("target_id"), (F.lit(1.0) / F.col("id")).cast("float").alias("score"))
    place = spark.range(1, n + 1).select(F.lit(1).cast("smallint").alias("layout_id"), F.col("id").cast("int").alias("artist_id"), F.lit(0.5).cast("float").alias("x"), F.lit(0.5).cast("float").alias("y"))
    weight = place.select(F.lit(1).cast("smallint").alias("metric_id"), "artist_id", F.lit(2).alias("degree"), F.lit(1.0).cast("float").alias("weight"))
    sky = spark.createDataFrame([(1, "k", 1, "", 1, None, n)], TABLES["sky_layout"][0])
    canon.replace({"artist": artist.select(names), ("artist_similarity", 1): far, ("artist_position", 1): place, ("artist_prominence", 1): weight, "sky_layout": sky}, "made", "1")
    card = jobs.card(canon, 500).first()
    assert card.name == "n500" and [s.other_id for s in card.similar] == [493, 507] and card.position.x == 0.5

    def touched(folder, column, value):
        hit = total = 0
        for path in (p for p in (canon.root + "/" + f for f in [folder])):
            for f in __import__("pathlib").Path(path).glob("*.parquet"):
                meta = pq.ParquetFile(f).metadata
                at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
                for g in range(meta.num_row_groups):
                    s = meta.row_group(g).column(at).statistics
                    total, hit = total + 1, hit + (s.min <= value <= s.max)
        return hit, total

    kept = canon.manifest()
    for folder, column in [(kept["artist_similarity"]["1"]["source_id"], "source_id"), (kept["artist_similarity"]["1"]["target_id"], "target_id"), (kept["artist"][""]["id"], "id"), (kept["artist_position"]["1"]["artist_id"], "artist_id")]:
        hit, total = touched(folder, column, 500)
        assert total >= 10 and hit <= 2, (column, hit, total)
