"""The lead of a text without markup needs no Python."""

import pandas as pd
from pyspark.sql import functions as F

from starloom.functions import markup


def test_python_gets_marked_texts_alone(spark, monkeypatch):
    @F.pandas_udf("string")
    def none(text: pd.Series) -> pd.Series:
        assert text.isna().all()
        return text

    prose = "Plain words that go on for  more than\tforty bytes, '''bold''' &amp; all."
    rows = spark.createDataFrame([(1, f"{prose}\n== Next ==\nmore"), (2, prose), (3, None), (4, "")], "id int, text string").coalesce(1)
    marked = spark.createDataFrame([(1, "{{x}}" + prose), (2, prose + "<ref>y</ref>")], "id int, text string")
    want = "Plain words that go on for more than forty bytes, bold & all."
    assert {r.x for r in marked.select(markup.lead(F.col("text")).alias("x")).collect()} == {want}
    monkeypatch.setattr(markup, "_without_templates", none)
    assert [r.x for r in rows.select("id", markup.lead(F.col("text")).alias("x")).orderBy("id").collect()] == [want, want, None, None]
