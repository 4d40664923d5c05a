"""SentencePiece encoding and decoding by a batched numpy Viterbi search over each distinct word's piece lattice.

For a unigram model an arc weighs its piece's score. For a BPE model the merge order admits exactly one path on which
every two neighbouring pieces, merged on their own, come out as these two pieces again; an arc weighs nothing if it
keeps to that and is barred otherwise, so the best path gives the ids that the merges give. Whether two pieces keep to
it follows from the ranks of the merges that made them, for many pairs at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .bytehash import mix
from .common import bounded_batches, in_parts, table, texts_of
from .packing import vocabulary
from .wordcache import BLOCK, IdLists, Remembered, blocks, by_text, spread

SPACE = "▁"
LONG_WORD = 32  # longer words are cut where no piece crosses
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of pieces and of models in the model file (fixed values).
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model file's pieces, ready to encode and decode. User-defined symbols count as ordinary pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(open(path, "rb").read())
        self.bpe = model.trainer_spec.model_type == BPE
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces], np.float64)
        kinds = [p.type for p in model.pieces]
        self.of = {p: i for i, (p, k) in enumerate(zip(self.text, kinds, strict=True)) if k in (NORMAL, USER)}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(self.text[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.raw = [bytes([int(t[1:-1], 16)]) if k == BYTE else t.encode() if k in (NORMAL, USER) else b"" for t, k in zip(self.text, kinds, strict=True)]
        self.longest = max(map(len, self.of))
        self.least = min(self.score[i] for i in self.of.values()) - _UNKNOWN_PENALTY
        self._index()
        self.prefix = " " if model.normalizer_spec.add_dummy_prefix else ""
        alone = "".join(c for c in "\n\t\r" if c not in self.of and not any(c in p for p in self.of))
        #: Bytes that stand alone as no piece has them; whether a piece has a space mark after another character.
        self._alone = np.isin(np.arange(256), list(alone.encode()))
        self._inner = any(SPACE in p.lstrip(SPACE) for p in self.of)
        if self.bpe:
            self._merge_tree()
        self._pairs = Remembered(20, 1, np.bool_)
        self._known = IdLists()
        self._raw_at = np.cumsum([0, *map(len, self.raw)])
        self._raw = np.frombuffer(b"".join(self.raw), np.uint8)

    def _index(self) -> None:
        """Pieces by the hashes of their characters: sorted, and where each of 2^18 ranges of hashes begins."""
        by_length: dict[int, list[str]] = {}
        for p in self.of:
            by_length.setdefault(len(p), []).append(p)
        self._size, self._sum = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.uint64)
        for n, same in by_length.items():
            ids = [self.of[p] for p in same]
            self._size[ids], self._sum[ids] = n, self._sums(self._codes(same), 0)[-1]
        ids = np.array(sorted(self.of.values()))
        keys = mix(self._sum[ids])
        order = np.argsort(keys)
        self._keys, self._ids = keys[order], ids[order]
        self._first = np.searchsorted(self._keys, np.arange((1 << 18) + 1, dtype=np.float64) * 2.0**46).astype(np.int32)
        self._most = int(np.diff(self._first).max())
        self._base = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE, np.uint64)]))

    def _piece(self, sums: np.ndarray) -> np.ndarray:
        """Ids of the pieces with the given sums of characters; -1 where there is none."""
        h = mix(sums)
        bucket = (h >> np.uint64(46)).astype(np.int64)
        at, end = self._first[bucket], self._first[bucket + 1]
        out = np.full(h.shape, -1, np.int32)
        left = np.flatnonzero(at < end)
        h, at, end = h.ravel()[left], at.ravel()[left], end.ravel()[left]
        for _ in range(self._most):
            same = self._keys[at] == h
            out.ravel()[left[same]] = self._ids[at[same]]
            go = ~same & (at + 1 < end)
            left, h, at, end = left[go], h[go], at[go] + 1, end[go]
        return out

    def _merge_tree(self) -> None:
        """For each piece the two parts whose merge makes it when its characters are merged on their own; -1 for single
        characters. `made` tells whether that gives the piece; `odd` whether a part is merged later than the whole."""
        n = len(self.text)
        self._rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        self._low, self._high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self._made, self._odd = self._size == 1, np.zeros(n, bool)
        for size in range(2, self.longest + 1):
            ids = np.flatnonzero(self._size == size)
            codes = self._codes([self.text[i] for i in ids])
            for cut in range(1, size):
                low, high = self._piece(self._sums(codes[:, :cut], 0)[-1]), self._piece(self._sums(codes[:, cut:], 0)[-1])
                fit = np.flatnonzero((low >= 0) & (high >= 0))
                fit = fit[self._made[low[fit]] & self._made[high[fit]] & ~self._odd[low[fit]] & ~self._odd[high[fit]]]
                for part in (low, high):
                    fit = fit[(self._size[part[fit]] == 1) | (self._rank[part[fit]] < self._rank[ids[fit]])]
                fit = fit[self._stay(low[fit], high[fit], self._rank[ids[fit]])]
                self._low[ids[fit]], self._high[ids[fit]], self._made[ids[fit]] = low[fit], high[fit], True
            for i in ids[~self._made[ids]]:
                self._made[i] = self._odd[i] = self.merged(self.text[i]) == [i]

    def _stay(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = 1 << 40) -> np.ndarray:
        """Whether pieces a and b, side by side, come out as themselves: no merge across their boundary before the
        given rank. Merges are taken back from the last on; what then stands at the boundary may not make a piece
        of a lower rank than the merge that was taken back (of two equal ranks the left one goes first)."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y, until = a.astype(np.int64), b.astype(np.int64), np.broadcast_to(np.int64(until), a.shape)
        while len(live):
            # A joint piece is no longer than the longest; longer ones need no look
            joint = self._piece(self._sum[x] * self._base[self._size[y]] + self._sum[y])
            crossed = (joint >= 0) & (self._rank[joint] < until)
            ok[live[crossed]] = False
            at_x, at_y = np.where(self._low[x] < 0, -1, self._rank[x]), np.where(self._low[y] < 0, -1, self._rank[y])
            back_y = at_y >= at_x
            go = ~crossed & (np.maximum(at_x, at_y) >= 0)
            until = np.where(back_y, at_y + 1, at_x)[go]
            x, y = np.where(back_y, x, self._high[x])[go], np.where(back_y, self._low[y], y)[go]
            live = live[go]
        return ok

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        """Code points of equally long words."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)

    def _sums(self, codes: np.ndarray, start: int) -> np.ndarray:
        """Sums of the characters from `start`: a row for each length."""
        h, ends = np.zeros(len(codes), np.uint64), []
        for end in range(start, min(codes.shape[1], start + self.longest)):
            h = h * _BASE + codes[:, end] + np.uint64(1)
            ends.append(h)
        return np.stack(ends)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Ids of the pieces at [word, start, length - 1] of equally long words; -1 where there is none."""
        n = len(words[0])
        codes = self._codes(words)
        found = np.full((len(words), n, min(n, self.longest)), -1, np.int32)
        for start in range(n):
            sums = self._sums(codes, start)
            found[:, start, : len(sums)] = self._piece(sums).T
        return found

    def merged(self, text: str) -> list[int]:
        """Merges of a short text, best score first, leftmost among equals; unknown characters give -1."""
        parts = list(text)
        while True:
            ids = [self.of.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((i for i, x in enumerate(ids) if x >= 0), key=lambda i: self.score[ids[i]], default=-1)
            if best < 0:
                return [self.of.get(p, -1) for p in parts]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b can follow a (-1: the word's start, -2: an unknown character) on the path that merges take."""
        key = mix((a.astype(np.int64) << 32 | b.astype(np.int64) + 2).view(np.uint64))
        at = self._pairs.find(key)
        out = self._pairs.value[at, 0]
        _, new = np.unique(key[at < 0], return_index=True)
        new = np.flatnonzero(at < 0)[new]
        x, y = a[new], b[new]
        ok = ((x < 0) | self._made[x]) & ((y < 0) | self._made[y])
        both = np.flatnonzero(ok & (x >= 0) & (y >= 0))
        ok[both] = self._stay(x[both], y[both])
        for k in both[self._odd[x[both]] | self._odd[y[both]]]:
            ok[k] = self.merged(self.text[x[k]] + self.text[y[k]]) == [x[k], y[k]]
        self._pairs.put(key[new], ok[:, None])
        missing = np.flatnonzero(at < 0)
        order = new[np.argsort(key[new])]
        out[missing] = ok[np.argsort(key[new])][np.searchsorted(key[order], key[missing])]
        return out

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of equally long words: (number of pieces of each, all pieces); unknown characters are given as -2."""
        n, count = len(words[0]), len(words)
        found = self.lattice(words)
        found[:, :, 0] = np.where(found[:, :, 0] < 0, -2, found[:, :, 0])
        last = np.full((count, n + 1), -1, np.int64)
        length = np.zeros((count, n + 1), np.int64)
        total = np.zeros((count, n + 1))
        rows = np.arange(count)
        for end in range(1, n + 1):
            spans = np.arange(1, min(end, found.shape[2]) + 1)
            piece = found[:, end - spans, spans - 1].astype(np.int64)
            weight = np.full(piece.shape, -np.inf)
            there = piece != -1
            if self.bpe:
                weight[there] = np.where(self.fits(last[:, end - spans][there], piece[there]), 0.0, -np.inf)
            else:
                weight[there] = np.where(piece == -2, self.least, self.score[piece])[there]
                weight += total[:, end - spans]
            best = weight.argmax(1)
            total[:, end], length[:, end], last[:, end] = weight[rows, best], spans[best], piece[rows, best]
        out, size = np.empty((count, n), np.int64), np.zeros(count, np.int64)
        end = np.full(count, n)
        while len(live := np.flatnonzero(end)):
            size[live] += 1
            out[live, n - size[live]] = last[live, end[live]]
            end[live] -= length[live, end[live]]
        return size, out[np.arange(n) >= (n - size)[:, None]]

    def _cuts(self, word: str) -> list[str]:
        """Parts of a long word, cut where no piece crosses; its best path is theirs in a row."""
        codes, block = self._codes([word])[0], 1 << 14
        reach = np.arange(1, len(word) + 1)
        for at in range(0, len(word), block):
            own = codes[at : at + block + self.longest - 1]
            h = np.zeros(min(block, len(word) - at), np.uint64)
            for k in range(self.longest):
                m = min(len(h), len(own) - k)
                if m <= 0:
                    break
                h = h[:m] * _BASE + own[k : k + m] + np.uint64(1)
                there = np.flatnonzero(self._piece(h) >= 0)
                reach[at + there] = at + there + k + 1
        ends = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, len(word) + 1)) + 1
        return [word[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        owner, parts = [], []
        for i, w in enumerate(words):
            cut = [w] if len(w) <= LONG_WORD else self._cuts(w)
            parts += cut
            owner += [i] * len(cut)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(parts):
            by_length.setdefault(len(w), []).append(i)
        where, size, flat = [], [], []
        for n, same in by_length.items():
            step = max(1, 2_000_000 // n // self.longest)
            for at in range(0, len(same), step):
                own = same[at : at + step]
                count, piece = self.paths([parts[i] for i in own])
                if (piece < 0).any():
                    count, piece = self._spelled([parts[i] for i in own], count, piece)
                where += own
                size.append(count)
                flat.append(piece)
        if not where:
            return np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        size, flat, where = np.concatenate(size), np.concatenate(flat), np.array(where)
        order = np.argsort(where)
        flat = flat[spread((np.cumsum(size) - size)[order], size[order])]
        return np.bincount(np.array(owner), size[order], len(words)).astype(np.int64), flat.astype(np.uint32)

    def _spelled(self, words: list[str], count: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same paths with unknown characters as their bytes, or as the unknown piece where there are none."""
        out, sizes, end = [], [], np.cumsum(count)
        for w, a, b in zip(words, end - count, end, strict=True):
            at, before = 0, len(out)
            for p in piece[a:b].tolist():
                if p >= 0:
                    out.append(p)
                    at += len(self.text[p])
                else:
                    out += [self.bytes[x] for x in w[at].encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                    at += 1
            sizes.append(len(out) - before)
        return np.array(sizes), np.array(out, np.int64)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids). A word is what stands from a space mark on that follows another
        character; characters that stand alone are words of their own."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        limit = np.cumsum([0, *map(len, raw)])
        begins = np.zeros(len(data) + 1, bool)
        if not self._inner:
            space, alone = data == 32, self._alone[data]
            begins[:-1] = alone
            begins[1:] |= alone
            begins[1:-1] |= space[1:] & ~space[:-1]
        begins[limit] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        h = bytehash.ranges(bytehash.prefix(data), start, end)
        count, ids = self._known.of(h, lambda new: self._encode_words([whole[a:b].decode("utf-8", "surrogatepass").replace(" ", SPACE) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
        sums = np.concatenate([[0], np.cumsum(count)])
        return np.diff(sums[np.searchsorted(start, limit)]), ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        out = [b""] * len(texts)
        whole = [self.prefix + t.replace(SPACE, " ") if t else "" for t in texts]
        for part, owner in [([t], [i]) for i, t in enumerate(whole) if t] if self._inner else blocks(whole, 4 * BLOCK):
            by_text(owner, *self._block(part), out)
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that make no character give U+FFFD."""
        piece = np.frombuffer(ids, "<u4").astype(np.int64)
        raw = self._raw[spread(self._raw_at[piece], self._raw_at[piece + 1] - self._raw_at[piece])].tobytes()
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text.removeprefix(self.prefix)


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the text made from them again.

    Null and empty texts have no ids; repeated rows stay; a text's own U+2581 comes back as a space, as the model
    file's convention has it; of paths that weigh the same the merges' own is taken; an empty table gives none; other
    columns are not read.
    """
    path = path or vocabulary("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for part in in_parts(batches):
            ids = model.encode(texts_of(part))
            column = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, ids array<int>, decoded string")


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest columns of encoded(), made beside it so that ids needn't leave the Python worker. Rows are treated as there:
    null and empty texts have no ids, repeated rows stay, an empty table gives none, other columns are not read."""
    path = path or vocabulary("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for part in in_parts(batches):
            texts = texts_of(part)
            ids = model.encode(texts)
            back = [model.decode(x) for x in ids]
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()),
                pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))
