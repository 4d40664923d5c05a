"""Source divergence against SQL and brute force, in tiles of other sizes too."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF, SF_LARGE

from starloom.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def brute(docs, least, top):
    by_group, by_lang, in_docs = {}, {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        by_group.setdefault((lang, source), Counter()).update(words)
        by_lang.setdefault(lang, Counter()).update(words)
        in_docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, source in by_group:
        kept = [w for w, n in in_docs[lang].items() if n >= least]
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, whole = share(by_group[lang, source]), share(by_lang[lang])
        pairs = [(sum(abs(p[w] - q[w]) for w in kept), other) for (own, other), counts in by_group.items() if own == lang and other != source for q in [share(counts)]]
        terms = [(p[w] - whole[w], w) for w in kept if by_group[lang, source][w] and p[w] > whole[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("sf", [SF, SF_LARGE])
def test_query_gives_what_sql_gives(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = con.execute(divergence.SQL)
    at = [[d[0] for d in answer.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[k] for k in at) for r in answer.fetchall()) == rows_of(divergence.op12_source_divergence(spark, sf))


def test_any_tiles_and_buckets(spark):
    """Odd rows, many small tiles and buckets: every joint table is put together from its parts."""
    rng = random.Random(3)
    words = ["a", "B", "é", "É", "zz", "mot", "x1y", "日本", "Σ", "it's"]
    docs = [(" ".join(rng.choices(words, range(10, 0, -1), k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice("abcdefghijk")) for _ in range(300)]
    docs += [(None, None, None), ("", "en", None), ("b " * 5000, "en", "a"), ("", "empty", "s"), ("once", "empty", "t"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "text string, lang string, source string, n bigint, term int, kept string")
    want = brute(docs, 30, 3)
    assert want and rows_of(divergence.audited(df, 30, 3)) == want
    assert rows_of(divergence.audited(df, 30, 3, tile=2, bucket=2)) == want
    assert divergence.audited(df.where("false")).count() == 0


def test_joint_table_is_the_product_of_one_hot_columns():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 4, (50, 3)), rng.integers(0, 9, (50, 2))
    (hot_a, source_a, count_a), (hot_b, source_b, count_b) = divergence.one_hot(left), divergence.one_hot(right)
    joint = hot_a.T @ hot_b
    for i, j in np.ndindex(joint.shape):
        assert joint[i, j] == np.sum((left[:, source_a[i]] == count_a[i]) & (right[:, source_b[j]] == count_b[j]))


def test_shares_are_exact_for_large_counts():
    count, total, kept = [0, 7, 10**13, 123456789012345], 8 * 10**15, 1000
    assert divergence.shares(np.array(count), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in count]
