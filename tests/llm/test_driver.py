"""What plans cost the driver: readings and expressions that stand once."""

import re

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from starloom.llm import bytehash, neardup, secrets


def test_findings_for_training_are_read_once(spark):
    for made in (secrets.decoys(spark), secrets.labelled_findings(spark.read.parquet(f"{SF}/documents.parquet"))):
        assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_sketches_differ_in_as_many_registers_as_are_counted(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(20).collect()]
    texts += [" ".join(t.split()[3:]) for t in texts] + ["one word"]
    rows = neardup._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    made = neardup.sketches(rows)
    p, q = ([f"{x}{k}" for k in range(neardup.SKETCH_WORDS)] for x in "pq")
    apart = neardup._apart(p, q)
    # Each word of a sketch stands once in the condition, as generated code and plans grow with it
    assert all(len(re.findall(rf"\b{w}\b", str(apart))) == 1 for w in p + q)
    pairs = neardup._sketch(made, "a", "p").crossJoin(neardup._sketch(made, "b", "q")).select("a", "b", apart.alias("n")).collect()
    owner, element, count = neardup.shingles(texts)
    low = bytehash.mix(neardup.both_minhashes(owner, element, count, len(texts), neardup.ROWS * neardup.BANDS)[1]) & np.uint64(15)
    assert len(pairs) == len(texts) ** 2 and all(r.n == (low[r.a] != low[r.b]).sum() for r in pairs)
    assert len({r.n for r in pairs}) > 20
