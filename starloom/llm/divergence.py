"""Source divergence by one-hot level products: how far the word shares of two sources of a language lie apart.

A term's share in a source depends on its count there alone, so the sum over terms of |p - q| is a sum over pairs of
counts. A block of terms has, for each source, an indicator column for each count that occurs (its levels). The product
of these columns' transpose with those of other sources is the joint table of every two sources: how many terms have
count a in one and b in the other. Each cell is then priced by |p(a) - q(b)|. Sources and terms are dealt out in tiles
of bounded size, so no task sees all terms of a source or all sources of a term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, in_parts, stage, table, texts_of

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
TILE_SOURCES = 32  # sources of a tile
BUCKET_TERMS = 1024  # terms of a task's share
BLOCK_TERMS = 64  # terms of one product
COUNTED_AT_ONCE = 400_000  # distinct terms that a counting task holds before it passes them on
#: ASCII letters in lower case; every other ASCII character separates terms (fixed rule of terms).
_FOLD = bytes((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, ASCII capitals in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of each term in each group. A row with an empty term
    stands for each group itself, so that a group without terms has one too. Null columns count as empty; a repeated row
    is a document of its own. Tasks add up what they read before it is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in in_parts(batches):
            for lang, source, text in zip(texts_of(part, "lang"), texts_of(part, "source"), texts_of(part), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter({b"": 1})
                    size += 1
                n, n_docs = held[lang, source]
                own, before = terms(text), len(n)
                n.update(own)
                n_docs.update(set(own))
                size += len(n) - before
            if size > COUNTED_AT_ONCE:
                yield from _records(held)
                held, size = {}, 0
        yield from _records(held)

    part = docs.select(*(F.col(c).cast("string") for c in ("lang", "source", "text")))
    parts = bounded_batches(part, rows, "lang string, source string, term string, n bigint, n_docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _records(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, n_docs) in held.items():
        n[b""] = n_docs[b""] = 0
        words = list(n)
        names = [pa.array([x] * len(words), pa.string()) for x in (lang, source)]
        counts = [pa.array([c[w] for w in words], pa.int64()) for c in (n, n_docs)]
        whole = pa.RecordBatch.from_arrays([*names, pa.array(words, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "n_docs"])
        for at in range(0, len(words), 1 << 16):
            yield whole.slice(at, 1 << 16)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)) in whole numbers; decimals, as products outgrow longs."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + SMOOTHING)
    return F.call_function("div", top, wide(total) + wide(kept) * SMOOTHING) + 1


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """The same for arrays: long division by thousands, exact for counts and totals under 9e15."""
    below = np.asarray(total, np.int64) + SMOOTHING * kept
    left, out = count.astype(np.int64) + SMOOTHING, np.zeros(count.shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


def one_hot(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of a block of counts (terms x sources): (terms x levels, each column's source, its count)."""
    n, width = counts.shape
    offset = np.arange(width, dtype=np.int64) * (int(counts.max(initial=0)) + 1)
    level, at = np.unique(counts + offset, return_inverse=True)
    source = np.searchsorted(offset, level, "right") - 1
    hot = np.zeros((n, len(level)), np.float32)
    hot[np.arange(n)[:, None], at.reshape(n, width)] = 1
    return hot, source, level - offset[source]


def priced(left: np.ndarray, right: np.ndarray, left_total: np.ndarray, right_total: np.ndarray, kept: int) -> np.ndarray:
    """Sums over terms of |p - q| for every source of `left` and of `right` (terms x sources counts).

    Products are of zeros and ones over at most BLOCK_TERMS terms, so single precision holds them exactly; sums are of
    whole numbers below 2^53 in a block and of longs over blocks."""
    out = np.zeros((left.shape[1], right.shape[1]), np.int64)
    order = np.argsort(left.sum(1) + right.sum(1), kind="stable")  # alike counts together: fewer levels a block
    for at in range(0, len(order), BLOCK_TERMS):
        own = order[at : at + BLOCK_TERMS]
        hot_a, source_a, count_a = one_hot(left[own])
        hot_b, source_b, count_b = (hot_a, source_a, count_a) if left is right else one_hot(right[own])
        joint = hot_a.T @ hot_b
        a, b = np.nonzero(joint)
        price = np.abs(shares(count_a, left_total[source_a], kept)[a] - shares(count_b, right_total[source_b], kept)[b])
        pair = source_a[a] * right.shape[1] + source_b[b]
        out += np.bincount(pair, price * joint[a, b].astype(np.float64), out.size).astype(np.int64).reshape(out.shape)
    return out


_TILE = "lang string, a string, b string, value bigint, seen bigint, apart bigint, kept bigint"


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of sources of one tile over one bucket of terms. Rows without a term tell each source's total."""
    rows = pa.Table.from_batches(list(batches))
    column = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("second", "source", "term", "n", "kept")}
    head = column["term"] == None  # noqa: E711
    kept = int(column["kept"][head][0])
    term, at_term = np.unique(column["term"][~head].astype(str), return_inverse=True) if not head.all() else (np.zeros(0, str), np.zeros(0, int))
    sides = []
    for side in (0, 1):
        own = head & (column["second"] == side)
        order = np.argsort(column["source"][own].astype(str), kind="stable")
        names, total = column["source"][own][order], column["n"][own][order].astype(np.int64)
        counts = np.zeros((len(term), len(names)), np.int64)
        of = {x: i for i, x in enumerate(names)}
        fill = column["second"][~head] == side
        counts[at_term[fill], [of[x] for x in column["source"][~head][fill]]] = column["n"][~head][fill]
        sides.append((names, total, counts))
    (a, total_a, left), (b, total_b, right) = sides
    same = not len(b)
    if same:
        b, total_b, right = a, total_a, left
    i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    value = priced(left, right, total_a, total_b, kept)[i, j]
    apart = np.abs(shares(np.zeros(len(a)), total_a, kept)[i] - shares(np.zeros(len(b)), total_b, kept)[j]) if kept else np.zeros(len(i), np.int64)
    lang = rows.column("lang")[0].as_py()
    columns = [[lang] * len(i), a[i].tolist(), b[j].tolist(), value, np.full(len(i), len(term)), apart, np.full(len(i), kept)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 3 else pa.int64()) for k, c in enumerate(columns)], [c.split()[0] for c in _TILE.split(", ")])


def divergences(groups: DataFrame, counts: DataFrame, tile: int = TILE_SOURCES, bucket: int = BUCKET_TERMS) -> DataFrame:
    """(lang, a, b, value) for every two sources a and b of a language, each pair once.

    groups: (lang, source, total, kept); counts: (lang, source, term, n, kept) of kept terms. Tiles hold about `tile`
    sources by their hashes, buckets about `bucket` terms. A row of counts goes to as many tasks as there are tiles, the
    replication of any blocked product. Terms that no source of a tile has meet at count 0 on both sides and are added
    by their number.
    """
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 1
    n_tiles = -(-most // tile)
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("kept") / bucket)).cast("int")
    own = F.pmod(F.xxhash64("source"), F.lit(n_tiles)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        """A copy for each tile that a row's source belongs to, as its first or second side."""
        other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("other")
        rows = rows.withColumn("own", own).select("*", other) if n_tiles > 1 else rows.withColumns({"own": F.lit(0), "other": F.lit(0)})
        first, last = F.least("own", "other"), F.greatest("own", "other")
        return rows.withColumns({"first": first, "last": last, "second": (F.col("own") != first).cast("int")}).select("lang", "first", "last", "bucket", "second", "source", "term", "n", "kept")

    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "kept", F.explode(F.sequence(F.lit(0), n_buckets - 1)).alias("bucket"))
    cells = counts.select("lang", "source", "term", "n", "kept", F.pmod(F.xxhash64("term"), n_buckets).cast("int").alias("bucket"))
    parts = dealt(heads).unionByName(dealt(cells)).groupBy("lang", "first", "last", "bucket").applyInArrow(_table_of_tile, _TILE)
    return parts.groupBy("lang", "a", "b").agg((F.sum("value") + F.when(F.max("kept") > 0, (F.max("kept") - F.sum("seen")) * F.max("apart")).otherwise(0)).alias("value"))


def _table_of_tile(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_tile(iter(rows.to_batches()))))


def audited(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, tile: int = TILE_SOURCES, bucket: int = BUCKET_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one (part `pair`),
    and the terms that it has more of than its language (part `term`, the first `top`).

    Null texts, languages and sources count as empty; a repeated row is a document of its own; an empty table gives none;
    ties go by the item's bytes; a language without kept terms has pairs of value 0; other columns are left out.
    """
    counts = stage(counted(docs), "term-counts")
    words = counts.where(F.col("term") != "")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_documents).drop("n_docs")
    kept = stage(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    cells = stage(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total"))), "groups")
    cells = cells.join(groups, ["lang", "source"])

    pairs = divergences(groups, cells, tile, bucket)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("bigint").alias("value")).where(F.col("value") > 0)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(more.withColumn("rank", place).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM words),
tokens AS (
  SELECT doc, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN cells USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
found AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
