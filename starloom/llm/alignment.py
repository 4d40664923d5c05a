"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, over a whole corpus.

Both tokenizers cut the same bytes; offsets at which both end cut the tokens into groups. Between two neighbouring ends
of either side lies one link, the token of A and the token of B that hold it, so a text's links follow from the two
lists of ends by a merge.

Most groups are one token on each side with the same bytes. For these an array from A's id to B's id of the same bytes is
made beforehand, and their occurrences are counted in vectors as long as the vocabulary. Only the links of all other
groups (irregular ones) are rows of their own: pairs of a text with how often each occurs there. The corpus's counts of
the vectors, and the highest count of each id of B, are bounded by the vocabularies and go to every task; so do the counts
of a bounded number of the most frequent pairs, which are what would be hot in a shuffle. All other pairs are joined.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import bounded_batches, in_parts, stage, table, texts_of
from .packing import vocabulary, written_bytes
from .pieces import SPACE, Pieces
from .wordcache import BLOCK, IdLists, blocks, by_text, spread

#: Pairs whose counts go to every task (16 bytes each); all others go through a join.
FREQUENT_PAIRS = 1 << 17
#: How byte-level tokenizers of this kind cut a text before they merge (a fixed value of the vocabulary's format).
_CHUNKS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that begin or are white space; a space behind one needn't begin a chunk.
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), *range(128, 256)])


class ByteLevel:
    """A byte-level BPE vocabulary file: ids of texts, with special tokens' strings as plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model["added_tokens"]}
        of = {written_bytes(t): i for t, i in model["model"]["vocab"].items() if i not in special}
        # Merges in the order of the ids that they make: then ids are ranks, and the faster library gives the same ids
        made = [of[b"".join(written_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))] for m in model["model"]["merges"]]
        pre = model["pre_tokenizer"]
        if made != sorted(made) or model["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"not a byte-level vocabulary with ids in the order of merges: {path}")
        self.raw = [b""] * (max([*of.values(), *special]) + 1)
        for b, i in of.items():
            self.raw[i] = b
        self._encoding = tiktoken.Encoding("byte-level", pat_str=_CHUNKS, mergeable_ranks=of, special_tokens={})

        self._known = IdLists()

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids). No chunk goes on from another character to white space, so what stands
        from such a space on to the next one is tokenised by itself, and remembered."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        limit = np.cumsum([0, *map(len, raw)])
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = (data[1:] == 32) & ~_WHITE[data[:-1]]
        begins[limit] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        count, ids = self._known.of(bytehash.ranges(bytehash.prefix(data), start, end), lambda new: self._fresh([whole[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
        return np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, limit)]), ids

    def _fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._encoding.encode_ordinary(w.decode("utf-8", "surrogatepass")) for w in words]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        out = [b""] * len(texts)
        for part, owner in blocks(texts, 4 * BLOCK):
            by_text(owner, *self._block(part), out)
        return out


class Bytes:
    """Bytes and decimal names of the ids of a vocabulary, to be put together for many ids at once."""

    def __init__(self, raw: list[bytes]):
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self._at, self._data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        names = [str(i).encode() for i in range(len(raw))]
        self.digits = np.fromiter(map(len, names), np.int64, len(raw))
        self.name = np.frombuffer(b"".join(n.ljust(len(names[-1]) + 1) for n in names), np.uint8).reshape(len(raw), -1)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self._data[spread(self._at[ids], self.size[ids])]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        of_byte = {i: bytes([x]) for x, i in self.b.bytes.items()}
        raw = [of_byte[i] if i in of_byte else t.replace(SPACE, " ").encode() for i, t in enumerate(self.b.text)]
        self.a_bytes, self.b_bytes = Bytes(self.a.raw), Bytes(raw)
        whole = {r: i for i, r in reversed(list(enumerate(raw))) if r and i not in of_byte}
        whole = {r: i for i, r in ((i, of_byte[i]) for i in of_byte) if r not in whole} | whole
        #: Id of B with the same bytes as each id of A; -1 where there is none.
        self.same = np.array([whole.get(r, -1) if r else -1 for r in self.a.raw], np.int64)

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; both empty where the bytes of a side aren't those of a space and the text."""
        none = np.zeros(0, np.int64)
        left, right = [none] * len(texts), [none] * len(texts)
        spaced = [f" {t}" if t else "" for t in texts]
        for i, (t, *sides) in enumerate(zip(spaced, self.a.encode(spaced), self.b.encode(texts), strict=True)):
            if t:
                whole = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in sides)
                if np.array_equal(self.b_bytes.joined(b), whole) and np.array_equal(self.a_bytes.joined(a), whole):
                    left[i], right[i] = a, b
        return left, right


class Aligned:
    """Groups and links of one or more texts in a row, whose bytes are the same on both sides."""

    def __init__(self, tokens: Aligner, a: np.ndarray, b: np.ndarray):
        self._tokens, self.a, self.b = tokens, a, b
        end_a, end_b = np.cumsum(tokens.a_bytes.size[a]), np.cumsum(tokens.b_bytes.size[b])
        self._ends_a, self._ends_b = np.zeros((2, 1 + (int(end_a[-1]) if len(a) else 0)), bool)  # by byte
        self._ends_a[end_a], self._ends_b[end_b] = True, True
        self.closes_a, self.closes_b = self._ends_b[end_a], self._ends_a[end_b]
        self.group_a, self.group_b = _before(self.closes_a), _before(self.closes_b)
        self.n_groups = int(self.closes_a.sum())

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A's place, B's place) of each link in order, and whether it is a group by itself whose ids the map joins."""
        ends = np.flatnonzero(self._ends_a | self._ends_b)
        at_a, at_b = _before(self._ends_a[ends]), _before(self._ends_b[ends])
        alone = (np.bincount(self.group_a, minlength=self.n_groups) == 1) & (np.bincount(self.group_b, minlength=self.n_groups) == 1)
        return at_a, at_b, alone[self.group_a[at_a]] & (self._tokens.same[self.a[at_a]] == self.b[at_b])

    def written(self, cuts: list[int]) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text; cuts: where each text's groups end."""
        mark_a = np.where(self.closes_a, ord("|"), ord(","))
        mark_b = np.where(self.closes_b, ord(";"), ord(","))
        sides = [(self._tokens.a_bytes, self.a, mark_a), (self._tokens.b_bytes, self.b, mark_b)]
        order = np.argsort(np.concatenate([self.group_a * 2, self.group_b * 2 + 1]), kind="stable")
        width = max(x.name.shape[1] for x, _, _ in sides)
        digits = np.concatenate([x.digits[ids] for x, ids, _ in sides])
        cells = np.zeros((len(digits), width), np.uint8)
        at = 0
        for x, ids, mark in sides:
            cells[at : at + len(ids), : x.name.shape[1]] = x.name[ids]
            cells[np.arange(at, at + len(ids)), x.digits[ids]] = mark
            at += len(ids)
        cells, digits = cells[order], digits[order]
        whole = cells[np.arange(width) <= digits[:, None]].tobytes()
        tokens = np.searchsorted(np.concatenate([self.group_a, self.group_b])[order], np.array([0, *cuts]))
        ends = np.concatenate([[0], np.cumsum(digits + 1)])[tokens].tolist()
        return [whole[p : q - 1] if q > p else b"" for p, q in zip(ends, ends[1:], strict=False)]


def _before(marks: np.ndarray) -> np.ndarray:
    """Number of marks before each place."""
    return np.cumsum(marks) - marks


_loaded: dict[tuple[str, str], Aligner] = {}


def loaded(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


_TEXTS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, regular array<int>, regular_n array<int>, pairs array<bigint>, pairs_n array<int>, total_ids array<int>, total_n array<bigint>"
_TEXT_TYPES = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_TEXT_NAMES = [c.split()[0] for c in _TEXTS.split(", ")]


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _counts_by_text(text: np.ndarray, value: np.ndarray, n_texts: int, kinds: tuple[pa.DataType, pa.DataType]) -> tuple[pa.Array, pa.Array]:
    """Distinct values of each text (some thousands at most) and how often each occurs there; values are under 2^48."""
    key = np.sort(text << 48 | value)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(first, len(key)))
    sizes = np.bincount(key[first] >> 48, minlength=n_texts)
    return _lists(sizes, key[first] & (1 << 48) - 1, kinds[0]), _lists(sizes, n, kinds[1])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """What each text has: numbers, digest, regular ids (A's) and irregular pairs with their counts there. A task's last row
    has no text but the task's vector of regular counts, as far as it isn't zero."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(a_path, b_path)
        totals = np.zeros(len(tokens.same), np.int64)
        for part in in_parts(batches):
            left, right = tokens.encoded(texts_of(part))
            n = len(left)
            n_a, n_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
            both = Aligned(tokens, np.concatenate(left), np.concatenate(right))
            closed = np.concatenate([[0], np.cumsum(both.closes_a)])[np.cumsum(n_a)]  # every text closes its last group
            n_groups = np.diff(np.concatenate([[0], closed]))
            at_a, at_b, regular = both.links()
            text = np.searchsorted(np.cumsum(n_a), at_a, "right")
            ids_a, ids_b = both.a[at_a], both.b[at_b]
            totals += np.bincount(ids_a[regular], minlength=len(totals))
            digests = [hashlib.sha256(w).hexdigest() if w else "" for w in both.written(closed.tolist())]
            lists = _counts_by_text(text[regular], ids_a[regular], n, (pa.int32(), pa.int32()))
            lists += _counts_by_text(text[~regular], ids_a[~regular] * len(tokens.b.text) + ids_b[~regular], n, (pa.int64(), pa.int32()))
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups)]
            nothing = [pa.nulls(n, t) for t in _TEXT_TYPES[-2:]]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *numbers, pa.array(digests, pa.string()), *lists, *nothing], _TEXT_NAMES)
        ids = np.flatnonzero(totals)
        vector = [pa.array([ids], _TEXT_TYPES[-2]), pa.array([totals[ids]], _TEXT_TYPES[-1])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _TEXT_TYPES[:-2]), *vector], _TEXT_NAMES)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return bounded_batches(texts, rows, _TEXTS)


def _vector(rows: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """Values of at most `size` keys below `size` as an array on the driver."""
    out = np.zeros(size, np.int64)
    found = rows.where(F.col(key).between(0, size - 1)).select(key, value).toArrow()
    out[found.column(key).to_numpy()] = found.column(value).to_numpy()
    return out


def counted(texts: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) from aligned() rows that are staged."""
    spark, tokens = texts.sparkSession, loaded(a_path, b_path)
    n_b = len(tokens.b.text)
    own = texts.where(F.col("row").isNotNull())
    vectors = texts.where(F.col("total_ids").isNotNull()).select(F.explode(F.arrays_zip("total_ids", "total_n")).alias("x"))
    regular = _vector(vectors.groupBy(F.col("x.total_ids").alias("a")).agg(F.sum("x.total_n").alias("n")), "a", "n", len(tokens.same))
    pairs = own.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pairs_n").alias("n"))
    pairs = stage(pairs, "pair-counts")

    # A pair of the same bytes can also occur in an irregular group; then its counts add up
    ids = np.flatnonzero(tokens.same >= 0)
    ids = ids[regular[ids] > 0]
    mapped = spark.createDataFrame(pa.table({"pair": pa.array(ids * n_b + tokens.same[ids], pa.int64()), "n": pa.array(regular[ids], pa.int64())}))
    mixed = pairs.join(F.broadcast(mapped.select("pair")), "pair", "left_semi").select(F.expr(f"pair div {n_b}").alias("a"), "n")
    regular += _vector(mixed, "a", "n", len(regular))
    mapped = spark.createDataFrame(pa.table({"pair": pa.array(ids * n_b + tokens.same[ids], pa.int64()), "n": pa.array(regular[ids], pa.int64())}))
    total = pairs.join(F.broadcast(mapped.select("pair", F.col("n").alias("whole"))), "pair", "left").select("pair", F.coalesce("whole", "n").alias("n"))
    b = F.col("pair") % n_b
    best = _vector(total.unionByName(mapped).groupBy(b.alias("b")).agg(F.max("n").alias("n")), "b", "n", len(tokens.b.text))
    top = total.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = top.column("pair").to_numpy()[order], top.column("n").to_numpy()[order]
    shared = spark.sparkContext.broadcast((regular, best, tokens.same, *known))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, best, same, pair, pair_n = shared.value
        for part in batches:
            flat, n = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("regular", "regular_n"))
            sizes = part.column("regular").value_lengths().to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            total, tops = _sums(text, n * regular[flat], len(sizes)), _sums(text, n * (regular[flat] == best[same[flat]]), len(sizes))
            flat, n = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "pairs_n"))
            sizes = part.column("pairs").value_lengths().to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            count = pair_n[at[hit]]
            total += _sums(text[hit], n[hit] * count, len(sizes))
            tops += _sums(text[hit], n[hit] * (count == best[flat[hit] % n_b]), len(sizes))
            rest = np.bincount(text[~hit], minlength=len(sizes))
            columns = [pa.array(tops, pa.int64()), pa.array(total, pa.int64()), _lists(rest, flat[~hit], pa.int64()), _lists(rest, n[~hit], pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in _NUMBERS] + columns, [*_NUMBERS, "n_best", "count_sum", "pairs", "pairs_n"])

    kinds = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, pairs_n array<int>"
    done = stage(own.select(*_NUMBERS, "regular", "regular_n", "pairs", "pairs_n").mapInArrow(rows, kinds), "known-pairs")
    bests = spark.createDataFrame(pa.table({"b": pa.array(np.flatnonzero(best), pa.int64()), "best": pa.array(best[best > 0], pa.int64())}))
    counts = total.join(F.broadcast(spark.createDataFrame(pa.table({"pair": pa.array(known[0], pa.int64())}))), "pair", "left_anti")
    counts = counts.withColumn("b", b).join(F.broadcast(bests), "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("best")).cast("int").alias("is_best"))
    rest = done.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pairs_n").alias("n"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("is_best")).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    out = done.drop("pairs", "pairs_n").join(rest, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


_NUMBERS = _TEXT_NAMES[:7]


def _sums(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by text (texts in order), exact as longs."""
    ends = np.concatenate([[0], np.cumsum(value)])
    return np.diff(ends[np.searchsorted(text, np.arange(n + 1))])


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """A row for each document: its tokens, groups and links, how many links are the most frequent of their id of B in the
    whole corpus, and the sum of the links' counts.

    Null and empty texts, and texts that a tokenizer doesn't give back whole, have zeros and an empty digest and count
    nowhere; repeated rows count as often as they occur; of ties all are the most frequent; an empty table gives none;
    other columns are left out.
    """
    paths = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    return counted(stage(aligned(docs, *paths), "aligned"), *paths, frequent)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
