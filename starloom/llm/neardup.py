"""Near-duplicates by ProbMinHash over weighted word shingles, banding, exact verification and linking.

A shingle is five words in a row; it weighs 1 + ln(times it occurs in the text). Each shingle is a Poisson process
whose rate is its weight; an arrival falls on a random register, and a register keeps the shingle that arrives first.
Two texts agree on a register with the probability Jaccard similarity of their weighted shingles. Shingles whose next
arrival is later than all registers' first ones are done, which ends the work early.

The exact Jaccard similarity of two shingle sets, which knows no weights, decides. So registers are made a second time
with all weights 1, where texts agree with just that probability. Texts that agree in a band of either are candidates;
only the registers of weight 1 may rule a candidate out. Shingles that occur once have the same arrivals in both.
Equal texts are one from the start. In a band's bucket every text is first compared with one of them, and where that
leaves several classes, with another one, and again; only texts that even then aren't in the last one's class are
compared with all others there, and of these pairs only those become rows that may be similar by what is kept of each
text: the sketch, and a bitmap of the parities of its shingles, by which two sets differ in as many shingles at least as
their bitmaps do in bits. So no link that joins classes is left out; a bucket of n near copies makes n rows, and besides
about as many as it has links between classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import bounded_batches, discard, in_parts, stage, table, texts_of

SHINGLE = 5
ROWS, BANDS = 9, 48
LEAST = 0.8
STARS = 3  # rounds in which a bucket's texts are compared with one of them, before the rest are with all
#: Words of the short sketch, which has four bits of each register (for each 64 registers a word of their first bits, one
#: of their second ones and so on), and the least estimate from it that goes on to verification: 3.2 deviations below 0.8.
SKETCH_WORDS = 4 * -(-ROWS * BANDS // 64)
LEAST_ESTIMATE = 0.735
PARITY_WORDS = 16  # of the bitmap, a power of two; it tells apart sets of up to about 1,000 shingles


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of each distinct shingle, sorted. Words are what stands between ASCII white space
    after lower-casing; a text of one to four words is one shingle."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    start, _, word = bytehash.words(data, data <= 32)
    limit = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(limit, start, "right")
    each = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(each) - each
    index = np.arange(len(word)) - first[owner]
    last = each[owner] - SHINGLE
    begins = np.flatnonzero((index <= last) | (index == 0))
    h = np.zeros(len(begins), np.uint64)
    for k in range(SHINGLE):
        at = begins + k
        inside = index[begins] + k < each[owner[begins]]
        h = np.where(inside, bytehash.mix(h * np.uint64(31) + word[np.minimum(at, len(word) - 1)]), h) if len(word) else h
    own = owner[begins]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return own[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def probminhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) elements that arrive first. owner: which of n sets an element is in, in order; 0 marks an empty set."""
    times, winner = np.full((n, registers), np.inf), np.zeros((n, registers), np.uint64)
    _arrive(owner, element, weight, times, winner)
    return winner


def _arrive(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, times: np.ndarray, winner: np.ndarray) -> None:
    """Let elements arrive at registers (n, registers), which hold first arrivals so far and what they brought."""
    n, registers = times.shape
    times, winner = times.reshape(-1), winner.reshape(-1)
    latest = np.empty(n)
    at, base, rate, who = np.zeros(len(owner)), element, weight.astype(np.float64), owner
    step = 0
    while len(who):
        step += 1
        h = bytehash.mix(base + np.uint64((0x9E3779B97F4A7C15 * step) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        slot = who * registers + (bytehash.mix(h) % np.uint64(registers)).astype(np.int64)
        better = at < times[slot]
        s, t, e = slot[better], at[better], base[better]
        np.minimum.at(times, s, t)
        won = times[s] == t
        winner[s[won]] = e[won]
        open_sets = who[np.concatenate([[True], who[1:] != who[:-1]])]
        latest[open_sets] = times.reshape(n, registers)[open_sets].max(1)
        open_ = at < latest[who]
        at, base, rate, who = at[open_], base[open_], rate[open_], who[open_]


def both_minhashes(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """probminhash() of weights 1 + ln(count), and of weights 1. Elements that occur once arrive for both together."""
    times, winner = np.full((n, registers), np.inf), np.zeros((n, registers), np.uint64)
    once = count == 1
    _arrive(owner[once], element[once], count[once], times, winner)
    sets, number = np.unique(owner[~once], return_inverse=True)
    out = []
    for weight in (1 + np.log(count[~once]), np.ones(len(number))):
        t, w = times[sets], winner[sets]
        _arrive(number, element[~once], weight, t, w)
        whole = winner.copy()
        whole[sets] = w
        out.append(whole)
    return out[0], out[1]


def _bands(got: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(n, bands) hashes of bands of registers."""
    band = np.full((len(got), bands), np.uint64(7))
    for r in range(rows):
        band = bytehash.mix(band * np.uint64(31) + got[:, r::rows])
    return bytehash.mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)


def parities(owner: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY_WORDS) bitmaps of n sets of hashes: a bit is set if an odd number of elements fall on it. What two sets
    share cancels out, so they differ in as many elements at least as their bitmaps do in bits."""
    bits = PARITY_WORDS.bit_length() + 5
    at = (element >> np.uint64(64 - bits)).astype(np.int64)
    out = np.zeros(n * PARITY_WORDS, np.uint64)
    np.bitwise_xor.at(out, owner * PARITY_WORDS + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out.reshape(n, PARITY_WORDS)


#: What tells texts apart: hash, checksum and bytes.
KEY = ["h", "c", "n"]
#: What sketches() adds.
MADE = ["bands", "bits", "parity", "distinct"]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, text, h, c, n) of the rows; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"h": F.xxhash64("text"), "c": F.crc32(F.col("text").cast("binary")), "n": F.octet_length("text").cast("bigint")})


def sketches(rows: DataFrame, n_rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, h, c, n, bands, bits, parity, distinct) of each row (id, text, h, c, n): the hashes of its bands (those of both
    weightings, equal ones once), a short sketch of the registers of weight 1, the bitmap and the number of its shingles;
    the lists are null where the text has no word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, most_bytes=1_000_000):
            whole = texts_of(part)
            owner, element, count = shingles(whole)
            weighted, got = both_minhashes(owner, element, count, len(whole), n_rows * bands)
            band = [x if (x == y).all() else np.union1d(x, y) for x, y in zip(_bands(weighted, n_rows, bands), _bands(got, n_rows, bands), strict=True)]
            low = (bytehash.mix(got) & np.uint64(15)).astype(np.uint8)
            low = np.pad(low, ((0, 0), (0, -low.shape[1] % 64)))
            planes = [np.packbits(low >> k & 1, axis=1).reshape(len(low), -1, 8) for k in range(4)]
            bits = np.ascontiguousarray(np.stack(planes, 2)).reshape(len(low), low.shape[1] // 2)
            empty = pa.array(~got.any(1))
            parity = parities(owner, element, len(whole))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (band, list(bits.view(np.int64)), list(parity.view(np.int64)))]
            distinct = pa.array(np.bincount(owner, minlength=len(whole)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", *KEY)), *(pc.if_else(empty, None, x) for x in lists), distinct], ["id", *KEY, *MADE])

    return bounded_batches(rows.select("id", "text", *KEY), sketch, "id bigint, h bigint, c bigint, n bigint, bands array<bigint>, bits array<bigint>, parity array<bigint>, distinct bigint")


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, own array<bigint>): the sorted shingle hashes of the wanted texts, made once for all comparisons. texts: as
    _keyed() gives them; wanted: (id, first, h, c, n), where `first` is the id of a row that has the text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            owner, element, _ = shingles(texts_of(part))
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))], ["id", "own"])

    one = texts.withColumnRenamed("id", "first").join(wanted, ["first", *KEY]).groupBy("id").agg(F.min("text").alias("text"))
    return bounded_batches(one, hashes, "id bigint, own array<bigint>")


def _similar(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose exact shingle-set Jaccard similarity is `least` or more; own: shingle_sets()."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if min(len(x), len(y)) >= least * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both >= least * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class): the least id that links lead to. Each round every node takes the least node beside it, that one's
    own choice is followed once, and the links are drawn anew between what is left; those inside a class go, so that
    rounds shrink quickly."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    state, old = nodes.select("id", F.col("id").alias("class")), []
    while not edges.isEmpty():
        hop = edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("to"))
        beyond = hop.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        step = stage(hop.join(beyond, "to", "left").select("id", F.coalesce("beyond", "to").alias("to")), "step")
        state = stage(state.join(step.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("to", "class").alias("class")), "classes")
        ends = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        after = stage(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(edges, step, *old)
        edges, old = after, [state]
    discard(edges)
    return state


def _apart(a: list[str], b: list[str]) -> Column:
    """Registers in which two short sketches differ in any of their four bits."""
    d = [F.col(x).bitwiseXOR(F.col(y)) for x, y in zip(a, b, strict=True)]
    return sum((F.bit_count(reduce(Column.bitwiseOR, d[k : k + 4])) for k in range(0, len(d), 4)), F.lit(0))


def _sketch(made: DataFrame, key: str, name: str, bitmap: bool = False) -> DataFrame:
    """(key, name0, name1, ...): the words of the short sketches; bitmap: name_parity0 ... and name_distinct too."""
    more = [*(F.col("parity")[k].alias(f"{name}_parity{k}") for k in range(PARITY_WORDS)), F.col("distinct").alias(f"{name}_distinct")]
    return made.select(F.col("id").alias(key), *(F.col("bits")[k].alias(f"{name}{k}") for k in range(SKETCH_WORDS)), *(more if bitmap else []))


def _within_reach(x: str, y: str, least: float) -> Column:
    """Whether the sets of shingles of two texts can have Jaccard similarity `least`: they have it if they differ in at
    most (1 - least) / (1 + least) of their numbers' sum."""
    differ = sum((F.bit_count(F.col(f"{x}_parity{k}").bitwiseXOR(F.col(f"{y}_parity{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    return differ <= (F.col(f"{x}_distinct") + F.col(f"{y}_distinct")) * ((1 - least) / (1 + least)) + 1e-6


def links(made: DataFrame, texts: DataFrame, named: DataFrame, least: float = LEAST, sketched: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verified links, classes) between distinct texts: `made` has their (id, *MADE), `named` their (id, first, h, c, n),
    `texts` all rows as _keyed() gives them. Pairs whose short sketches rule them out are never made: that test is
    part of the joins' conditions; without `sketched` all pairs of a bucket are compared in full. Links inside a class that
    is already joined aren't looked for."""
    made = made.where(F.col("bands").isNotNull())
    p, q = ([f"{x}{k}" for k in range(SKETCH_WORDS)] for x in "pq")
    likely = _apart(p, q) <= int((1 - LEAST_ESTIMATE) * 15 / 16 * ROWS * BANDS) if sketched else F.lit(True)
    entry = made.select("id", F.explode("bands").alias("bucket"))
    # Aggregates are written out before they are joined back: both sides are then shuffled for the join, and Spark can
    # split a bucket or a group of copies that holds very many rows
    heads = entry.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stage(entry.join(stage(heads.select("bucket", "head"), "heads"), "bucket"), "buckets")
    own = stage(shingle_sets(texts, named.join(buckets.select("id").distinct(), "id", "left_semi")), "shingles")

    def verified(star: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are similar."""
        other = _sketch(made, "b", "q")
        star = star.join(_sketch(made, "a", "p"), "a").join(other, (star["b"] == other["b"]) & likely).select("a", star["b"])
        return stage(_similar(star, own, least), "links")

    found = verified(buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    classes, first = stage(components(made, found), "classes"), found
    # Buckets that still hold several classes: all against another head, as long as there are such and STARS allows
    buckets = buckets.drop("head")
    for star in range(1, STARS + 1):
        known = stage(buckets.join(classes, "id"), "known")
        head = F.min_by(F.struct("id", "class"), F.xxhash64("id", F.lit(star))).alias("head")
        mixed = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), head).where("low <> high")
        mixed = stage(mixed.select("bucket", F.col("head.id").alias("head"), F.col("head.class").alias("head_class")), "heads")
        known = stage(known.join(mixed, "bucket"), "known")
        if known.isEmpty():
            return first, classes
        buckets = known.select("bucket", "id")
        if star < STARS:
            found = verified(known.where("class <> head_class").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
            classes, first = _merged(classes, found), first.unionByName(found)
    # What a bucket then still holds in more than one class: its rest against all that is there, in other classes
    rest = known.where("class <> head_class").select("bucket", F.col("id").alias("a"), F.col("class").alias("ca"))
    other = known.select("bucket", F.col("id").alias("b"), F.col("class").alias("cb"), (F.col("class") == F.col("head_class")).alias("main"))
    rest, other = rest.join(_sketch(made, "a", "p", bitmap=sketched), "a"), other.join(_sketch(made, "b", "q", bitmap=sketched), "b")
    if sketched:
        likely = likely & _within_reach("p", "q", least)
    meet = (rest["bucket"] == other["bucket"]) & (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & likely
    crossed = rest.join(other, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = stage(_similar(crossed, own, least), "links")
    return first.unionByName(second), _merged(classes, second)


def _merged(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes (id, class) after more links: what is new joins whole classes."""
    if found.isEmpty():
        return classes
    of = lambda key, out: classes.select(F.col("id").alias(key), F.col("class").alias(out))
    between = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    above = components(classes.select(F.col("class").alias("id")).distinct(), between).select(F.col("id").alias("class"), F.col("class").alias("top"))
    return stage(classes.join(above, "class").select("id", F.col("top").alias("class")), "classes")


def _labelled(rows: DataFrame, least: float, sketched: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the rows' ids and keys, all distinct texts as h, c, n, n_copies, class_id, stands): a text stands for its class
    if its row is the class's first by doc_id and then by key. Texts are numbered, so ids may repeat."""
    made = stage(sketches(rows.where(F.col("id").isNotNull())), "sketches")
    groups = made.groupBy(*KEY).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    groups = stage(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    chosen = made.withColumnRenamed("id", "first").join(groups.drop("n_copies"), ["first", *KEY]).select("id", *MADE).dropDuplicates(["id"])
    _, label = links(chosen, rows, groups.drop("n_copies"), least, sketched)
    joined = stage(groups.join(label, "id", "left").withColumn("class", F.coalesce("class", "id")), "labels")
    top = stage(joined.groupBy("class").agg(F.min(F.struct("first", *KEY)).alias("top")), "tops")
    named = joined.join(top, "class").select(*KEY, "n_copies", F.col("top.first").alias("class_id"), (F.col("top") == F.struct("first", *KEY)).alias("stands"))
    return made.select("id", *KEY), stage(named, "named")


def classes(docs: DataFrame, least: float = LEAST, sketched: bool = True) -> DataFrame:
    """(doc_id, class_id, n_copies) of each row. class_id is the least doc_id that links lead to; n_copies counts the rows
    with the same text.

    Null texts count as empty; texts without a word are linked to their exact copies alone; a row without doc_id has
    neither class nor count, as nothing can name it. Repeated rows stay; different texts under one doc_id are each
    compared for themselves, and may bear one class_id without being alike. An empty table gives none; other columns
    are not read. sketched: pairs that short sketches rule out aren't compared, which may miss a link at the very edge of
    `least`; without it every pair that shares a band is compared in full.
    """
    rows = _keyed(docs)
    made, named = _labelled(rows, least, sketched)
    out = made.join(named, KEY).select(F.col("id").alias("doc_id"), "class_id", "n_copies")
    return out.unionByName(docs.where(F.col("doc_id").isNull()).select(*(F.lit(None).cast("bigint").alias(c) for c in out.columns)))


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class: that of the least doc_id, among different texts under this id that of the least key, among
    rows equal in both the least by the columns that Spark can order. All columns stay; so do all rows without doc_id."""
    named = _labelled(_keyed(docs), least)[1]
    own = ["_id", *(f"_{k}" for k in KEY)]
    keep = named.where("stands").select(F.col("class_id").alias("_id"), *(F.col(k).alias(f"_{k}") for k in KEY))
    text = F.coalesce(docs["text"], F.lit(""))
    keys = [docs["doc_id"].cast("bigint"), F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text).cast("bigint")]
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    rows = docs.where(docs["doc_id"].isNotNull()).select(*(k.alias(c) for k, c in zip(keys, own, strict=True)), whole).join(keep, own, "left_semi")
    order = F.struct(*(F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    one = rows.groupBy(*own).agg(F.min_by("_row", order).alias("_row"))
    return one.select("_row.*").unionByName(docs.where(docs["doc_id"].isNull()))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
