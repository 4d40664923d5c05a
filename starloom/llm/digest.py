"""Improbable-feature digests: rare byte windows, chosen by the corpus's own entropy counts, in chained Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import bounded_batches, in_parts, stage, table, texts_of

WINDOW = 32  # bytes in a feature
NEIGHBOURS = 64  # adjacent windows among which the rarest counts
LEVELS = 1000
LEAST_WINS = 16  # of the 64 neighbourhoods of a window, those in which it must be the rarest
GROUP_BYTES = 1 << 17  # texts are taken together up to this size, so that arrays stay in a core's cache
LONG_BYTES = 1 << 20  # longer texts are worked on in blocks
MARGIN = WINDOW + 2 * NEIGHBOURS
PER_FILTER = 160
FILTER_BITS = 2048
HASHES = 5
_c = np.arange(WINDOW + 1, dtype=np.float64)
_clogc = _c * np.log(np.maximum(_c, 1))
#: What the (c+1)-th equal byte adds to the window's sum of c log c, in 2^-16.
_GAIN = np.rint(np.diff(_clogc) * 65536).astype(np.int32)


def levels(data: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Shannon entropy of each window, from 0 to LEVELS (all bytes distinct)."""
    n, w = len(data), WINDOW
    if n < w:
        return np.zeros(0, np.int16)
    out = np.empty(n - w + 1, np.int16)
    for at in range(0, n - w + 1, block):
        b = data[at : at + block + w - 1]
        before, after, same = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8), np.empty(len(b), np.bool_)
        for k in range(1, w):
            eq = np.equal(b[k:], b[:-k], out=same[k:]).view(np.uint8)
            before[k:] += eq
            after[:-k] += eq
        gain, loss = _GAIN[before], _GAIN[after]
        total = np.empty(len(b) - w + 1, np.int64)
        total[0] = gain[:w].sum()
        total[1:] = total[0] + np.cumsum(gain[w:].astype(np.int64) - loss[: len(b) - w])
        out[at : at + block] = np.rint(LEVELS * (1 - total / (65536 * w * np.log(w))))
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with gaps that no window spans: (buffer, starts, lengths)."""
    gap = b"\0" * (WINDOW + NEIGHBOURS)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + len(gap))])[:-1] + len(gap)
    return np.frombuffer(gap + gap.join(texts) + gap, np.uint8), start, size


def _inside(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which windows lie in a text."""
    edge = np.zeros(n + 1, np.int8)
    ok = size >= WINDOW
    edge[start[ok]] += 1
    edge[(start + size - WINDOW + 1)[ok]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def level_counts(texts: list[bytes]) -> np.ndarray:
    data, start, size = joined(texts)
    found = levels(data)
    return np.bincount(found[_inside(len(found), start, size)], minlength=LEVELS + 1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the rarest comes first, ties in order; almost constant windows and those that look
    random are no features."""
    out = np.empty(LEVELS + 1, np.int16)
    out[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    out[: LEVELS // 10] = out[LEVELS * 99 // 100 :] = -1
    return out


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > GROUP_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """A digest for each text: rows of FILTER_BITS/8 bytes, one for each filter of the chain. An empty text has none;
    one without a feature (short, or of one repeated byte) counts as a single feature."""
    out = []
    for group in groups(texts):
        found = [_long_features(group[0], rank)] if len(group[0]) > LONG_BYTES else [_features(group, rank)]
        out += _filled(*found[0], len(group))
    return out


def _features(texts: list[bytes], rank: np.ndarray, core: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the selected windows, in order; texts without one have the hash of the whole. core: only
    windows that start there in the single text."""
    data, start, size = joined(texts)
    found = rank[levels(data)]
    kind, shift = (np.int32, 21) if len(data) < 1 << 20 else (np.int64, 40)
    none = np.iinfo(kind).max
    key = found.astype(kind) << shift | np.arange(len(found), dtype=kind)
    key[~_inside(len(found), start, size) | (found < 0)] = none
    for step in (1, 2, 4, 8, 16, 32):
        key = np.minimum(key[:-step], key[step:])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.diff(np.concatenate([first, [len(key)]]))
    won = (key[first[(run >= LEAST_WINS) & (key[first] != none)]] & ((1 << shift) - 1)).astype(np.int64)
    sums = bytehash.prefix(data)
    if core is not None:
        won = won[(won - start[0] >= core.start) & (won - start[0] < core.stop)]
        return np.zeros(len(won), np.int64), bytehash.ranges(sums, won, won + WINDOW)
    owner = np.searchsorted(start, won, "right") - 1
    bare = np.setdiff1d(np.flatnonzero(size), owner)
    feature = np.concatenate([bytehash.ranges(sums, won, won + WINDOW), bytehash.ranges(sums, start[bare], (start + size)[bare])])
    return np.concatenate([owner, bare]), feature


def _long_features(text: bytes, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_features() of one long text, block by block; what decides about a window lies within MARGIN of it."""
    found = []
    for at in range(0, len(text), LONG_BYTES):
        low = max(0, at - MARGIN)
        found.append(_features([text[low : at + LONG_BYTES + MARGIN]], rank, slice(at - low, at - low + LONG_BYTES))[1])
    feature = np.concatenate(found)
    if not len(feature):
        h = hashlib.blake2b(text, digest_size=8).digest()
        feature = np.frombuffer(h, np.uint64)
    return np.zeros(len(feature), np.int64), feature


def _filled(owner: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    """Chains of filters of n texts, from their features."""
    keep = np.sort(np.unique(bytehash.mix(feature ^ bytehash.mix(owner.astype(np.uint64))), return_index=True)[1])
    keep = keep[np.argsort(owner[keep], kind="stable")]
    owner, feature = owner[keep], feature[keep]
    each = np.bincount(owner, minlength=n)
    ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    filters = -(-each // PER_FILTER)
    base = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), FILTER_BITS), np.bool_)
    row = base[owner] + ordinal // PER_FILTER
    for k in range(HASHES):
        bits[row, (feature >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + f] for b, f in zip(base, filters, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: for each filter of the shorter chain its best normalised overlap with one of the other, averaged
    by the filter's set bits. Overlap counts beyond three deviations over what chance gives."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    best = np.empty(len(x))
    for i, row in enumerate(x):
        both = np.bitwise_count(row & y).sum(1, dtype=np.int64)
        most, chance = np.minimum(nx[i], ny), nx[i] * ny / FILTER_BITS
        floor = np.minimum(chance + 3 * np.sqrt(chance), most - 1)
        best[i] = np.clip((both - floor) / (most - floor), 0, 1).max()
    return float((best * nx).sum() / nx.sum())


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks from the entropy counts of all windows of all texts; LEVELS + 1 numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for part in in_parts(batches):
            for group in groups([t.encode("utf-8", "surrogatepass") for t in texts_of(part)]):
                total += level_counts(group)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in bounded_batches(docs.select("text"), count, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    return ranks(counts)


def _cuts(rows: DataFrame, rows_per_bin: int, most_bins: int) -> DataFrame:
    """One row: the cut points between bins (cuts, an array in order) and the least key (least). Keys are (k, h); every
    tenth of a sample by hash becomes a cut. The row is made by Spark and goes to all tasks: 16 bytes a cut."""
    each = max(rows_per_bin, rows.count() // most_bins)
    key = F.struct("k", "h")
    chosen = F.when(F.pmod(F.xxhash64("k", "h"), F.lit(max(1, each // 10))) == 0, key)
    one = rows.agg(F.min(key).alias("least"), F.sort_array(F.collect_set(chosen)).alias("keys"))
    return stage(one.select("least", F.filter("keys", lambda _, i: i % 10 == 9).alias("cuts")), "cuts")


def followed(docs: DataFrame, rows_per_bin: int = 1000, most_bins: int = 200_000) -> DataFrame:
    """Rows in bins of descending doc_id, each bin followed by a copy (ghost = 1) of the row that comes after it.

    Cuts are keys of rows, so that a bin's first row is known by its key and needs no search. A row finds its bin by
    halving among the cuts. The row after the last is the first. Rows with equal ids stand in the order of hashes of
    their texts, so that many may be dealt out too (those equal in both are of one bin); those without an id (or with the
    least there is) come last. Bins are sorted on disk, so they may be larger than a task's memory.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), "h": F.xxhash64("text")})
    rows = rows.crossJoin(F.broadcast(_cuts(rows, rows_per_bin, most_bins)))
    at = lambda p: F.get("cuts", p - 1)
    reached = lambda p: (at(p)["k"] < F.col("k")) | ((at(p)["k"] == F.col("k")) & (at(p)["h"] <= F.col("h")))
    steps = F.array(*(F.lit(1 << s) for s in range(most_bins.bit_length() + 3, -1, -1)))
    step = lambda p, s: F.when((p + s <= F.size("cuts")) & reached(p + s), p + s).otherwise(p)
    own = F.aggregate(steps, F.lit(0), step)
    same = lambda c: (c["k"] == F.col("k")) & (c["h"] == F.col("h"))
    rows = rows.select("doc_id", "text", "k", "h", own.alias("bin"), F.size("cuts").alias("last"), F.coalesce(same(at(own)), F.lit(False)).alias("starts"), same(F.col("least")).alias("first"))
    place = lambda b, g: F.struct(b.cast("int").alias("bin"), F.lit(g).alias("ghost"))
    ghosts = [F.when(F.col("starts"), place(F.col("bin") - 1, 1)), F.when(F.col("first"), place(F.col("last"), 1))]
    out = rows.withColumn("place", F.explode(F.array_compact(F.array(place(F.col("bin"), 0), *ghosts)))).select("doc_id", "text", "place.bin", "place.ghost", "k", "h")
    return out.repartition("bin").sortWithinPartitions("bin", "ghost", "k", "h", "text").select("doc_id", "text", "bin", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of each text, of its edited form (its last half replaced by the start of the next document in descending
    doc_id), and their likeness to each other and to the next document.

    Null texts count as empty; a lone document is its own next; repeated rows follow each other in any order, as they
    are equal. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    rank = corpus_ranks(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for part in in_parts(batches):
            got = list(zip(*(part.column(c).to_pylist() for c in ("bin", "ghost", "doc_id", "text")), strict=True))
            chain = [held, *got] if held else got
            pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if a[0] == b[0] and not a[1]]
            held = chain[-1]
            if not pairs:
                continue
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            whole = [pairs[0][0][3], *(b[3] for _, b in pairs)]
            where = {id(pairs[0][0]): 0} | {id(b): k + 1 for k, (_, b) in enumerate(pairs)}
            raw = [t.encode("utf-8", "surrogatepass") for t in whole + edited]
            own = digests(raw, rank)
            out = []
            for k, (a, b) in enumerate(pairs):
                if id(a) not in where:
                    where[id(a)] = len(own)
                    own += digests([a[3].encode("utf-8", "surrogatepass")], rank)
                x, y, e = own[where[id(a)]], own[where[id(b)]], own[len(whole) + k]
                out.append((a[2], len(a[3]), hashlib.sha256(raw[len(whole) + k]).hexdigest(), x.tobytes().hex(), e.tobytes().hex(), likeness(x, e), likeness(x, y)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return bounded_batches(followed(docs), rows, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, ["bigint", "bigint", "string", "string", "string", "double", "double"], strict=True)))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
