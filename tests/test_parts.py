"""What a task of the queries over all lines holds doesn't grow with the tables, and costly steps are taken once a row."""

import pytest
from conftest import SF

from starloom.plans import canon, queries


@pytest.mark.parametrize("name", ["artist_genre_counts", "release_group_year"])
def test_parts_follow_the_lines(spark, monkeypatch, name):
    monkeypatch.setattr(canon, "LINES_A_PART", 300)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= lines // 300


def test_an_entity_is_parsed_once(spark):
    plan = queries.QUERIES["facts_json"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("format_string(") == 1
