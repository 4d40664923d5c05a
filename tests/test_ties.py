"""Rows that an order leaves open come out the same however the table lies."""

from types import SimpleNamespace

from starloom.plans import canon


def test_relations_of_an_orders_several_first_lines(spark):
    lines = [(1, 9, 1, 0.06), (2, 9, 1, 0.02), (2, 9, 1, 0.05), (3, 9, 1, 0.06), (4, 8, 1, 0.01)]
    got = []
    for rows in (lines, lines[::-1]):
        t = SimpleNamespace(lineitem=spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_discount double").coalesce(1))
        got.append(sorted((r.id_0, r.id_1, round(r.score, 6)) for r in canon.relations(t).collect()))
    assert got[0] == got[1] == [(1, 2, 0.2), (2, 2, 0.2), (2, 3, 0.5)]
