"""Near-duplicates: how many of the planted edits are found, by bands of similarity; and what the sketches miss."""

import random

import pytest
from conftest import SF_LARGE

from starloom.llm import neardup

BANDS = [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)]
EACH = 500


def sets(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def planted(texts, rng):
    """[(text, edit, band)]: texts with some of their words replaced, EACH of every band by their exact similarity."""
    out = {b: [] for b in BANDS}
    while any(len(v) < EACH for v in out.values()):
        low, high = rng.choice([b for b in BANDS if len(out[b]) < EACH])
        text = rng.choice(texts)
        words = text.split()
        goal = rng.uniform(low, high)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * (1 - goal) / (1 + goal) / 5))):
            words[at] = f"w{rng.randrange(10**9)}"
        edit = " ".join(words)
        a, b = sets(text), sets(edit)
        likeness = len(a & b) / len(a | b)
        if low <= likeness < high:
            out[low, high].append((text, edit))
    return out


def test_planted_edits_are_found(spark):
    rng = random.Random(9)
    docs = [r.text for r in spark.read.parquet(f"{SF_LARGE}/documents.parquet").select("text").collect()]
    whole = [" ".join(t.lower().split()) for t in docs if 60 <= len(t.split()) <= 600]
    made = planted(whole, rng)
    rows, pairs = [(i, t) for i, t in enumerate(docs)], []
    for band, found in made.items():
        for text, edit in found:
            rows += [(len(rows), text), (len(rows) + 1, edit)]
            pairs.append((band, len(rows) - 2, len(rows) - 1))
    of = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for band in BANDS:
        own = [of[a] == of[b] for x, a, b in pairs if x == band]
        recall = sum(own) / len(own)
        print(band, len(own), recall)
        assert len(own) == EACH and recall >= 0.9, (band, recall)


@pytest.mark.parametrize("sketched", [False])
def test_sketches_miss_nothing_here(spark, sketched):
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(neardup.classes(docs)) == rows(neardup.classes(docs, sketched=sketched))
