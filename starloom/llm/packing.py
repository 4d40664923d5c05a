"""Best-fit packing of tokenised documents into sequences of a fixed length, with a bounded number of open bins."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import bounded_batches, in_parts, stage, table, texts_of
from .wordcache import IdLists, blocks, by_text, narrow_spaces

SEQUENCE = 4096
OPEN_BINS = 1024
END_ID = 1
TOKENS_PER_TASK = 1 << 24
#: What bytes are: white space, letters and digits of ASCII, its marks; the rest is none of these.
_SPACE, _WORD, _MARK = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
for _b in range(128):
    _KIND[_b] = _SPACE if _b == 32 or 9 <= _b <= 13 else _WORD if chr(_b).isalnum() else _MARK if _b > 32 and _b < 127 else 0
#: The character that byte-level tokenizers write for each byte: itself if it can be seen, else one from 256 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_WRITTEN = {b: chr(b) for b in _SEEN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
_BYTE = {c: b for b, c in _WRITTEN.items()}


def written_bytes(token: str) -> bytes:
    """The bytes of a token of a byte-level vocabulary."""
    return bytes(map(_BYTE.__getitem__, token))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokens:
    """Ids of whole texts by a tokenizer that lowers case, never joins characters across white space and takes letters
    and what follows them apart. Each distinct chunk between white space, without the marks at its end, is tokenised
    once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer, self._known = Tokenizer.from_file(path), IdLists()

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids). A chunk of letters alone is one word to the tokenizer, so that its model
        can be asked directly."""
        model, found, rest = self._tokenizer.model, [None] * len(chunks), []
        for i, c in enumerate(chunks):
            if c.isalpha():
                found[i] = [t.id for t in model.tokenize(c if c.isascii() else "".join(map(_WRITTEN.__getitem__, c.encode())))]
            else:
                rest.append(i)
        for i, e in zip(rest, self._tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            found[i] = e.ids
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([x for ids in found for x in ids], np.uint32)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b" ".join(raw) + b" "
        data = np.frombuffer(whole, np.uint8)
        kind = _KIND[data]
        edge = np.diff(np.concatenate([[1], kind & _SPACE, [1]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        # Marks at a chunk's end are taken apart from a letter or digit before them
        inner = np.maximum.accumulate(np.where(kind & _MARK, -1, np.arange(len(kind))))
        stem = np.where(len(end) and inner[end - 1] >= start, inner[end - 1] + 1, end) if len(end) else end
        stem = np.where((stem < end) & (kind[stem - 1] == _WORD), stem, end)
        start, end = np.concatenate([start, stem[stem < end]]), np.concatenate([stem, end[stem < end]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        h = bytehash.ranges(bytehash.prefix(data), start, end)
        count, ids = self._known.of(h, lambda new: self._fresh([whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
        sums = np.concatenate([[0], np.cumsum(count)])
        return np.diff(sums[np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))]), ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = [b""] * len(texts)
        plain = [t.lower() for t in texts]
        for i, (t, low) in enumerate(zip(texts, plain, strict=True)):
            # A special token's text must stay as it is; Python's lower() looks at what stands around a capital sigma;
            # and the tokenizer composes characters before it lowers them
            if "<|" in t or not t.isascii() and ("Σ" in t or not unicodedata.is_normalized("NFC", low)):
                out[i], plain[i] = np.array(self._tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ""
            else:
                plain[i] = narrow_spaces(low)
        for part, owner in blocks(plain):
            by_text(owner, *self._block(part), out)
        return out


_tokens: dict[str, ChunkTokens] = {}


def loaded(path: str) -> ChunkTokens:
    if path not in _tokens:
        _tokens[path] = ChunkTokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and an end id, cut only where over `most`."""
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path)
        for part in in_parts(batches):
            out = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.ids(texts_of(part)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    own = ids[at : at + 4 * most]
                    out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES[:5], strict=True)], _NAMES[:5])

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class BestFit:
    """Online best-fit with a bounded number of open bins. A bit for each amount of free space tells whether an open
    bin has it; the lowest bit from the wanted amount on is the best fit, the lowest of all is the fullest bin."""

    def __init__(self, size: int = SEQUENCE, most_open: int = OPEN_BINS):
        self.size, self.most_open, self.free, self.bins, self.open, self.made = size, most_open, 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next item; its length is from 1 to `size`."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if length < self.size and self.open >= self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.size, self.made
            self.made += 1
        if left := space - length:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        own = self.bins[space]
        number = own.pop()
        if not own:
            del self.bins[space]
            self.free ^= 1 << space
        self.open -= 1
        return number


def place_all(lengths: Iterable[int], size: int = SEQUENCE, most_open: int = OPEN_BINS) -> list[tuple[int, int]]:
    fit = BestFit(size, most_open)
    return [fit.place(n) for n in lengths]


def pack(cut: DataFrame, size: int = SEQUENCE, most_open: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces. Pieces arrive in the order of a hash, so that short ones are at hand for
    the gaps of long ones; a task packs about `tokens_per_task`, so that its last open bins weigh little."""
    total = cut.agg(F.sum("length").alias("n")).first().n or 0
    order = F.xxhash64("doc_id", "piece", "ids_crc32")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(size, most_open), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [fit.place(n) for n in b.column("length").to_pylist()]
            columns = [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], _NAMES)

    spread = cut.coalesce(max(1, -(-total // tokens_per_task))).sortWithinPartitions(order, "doc_id", "piece", "length", "start")
    return spread.mapInArrow(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, most_open: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `size` ids.

    Null and empty texts give the end id alone; repeated rows are packed as often as they occur; an empty table gives
    none. The pieces (a few numbers each, no text) are written to the shared folder once, as packing reads them twice.
    """
    return pack(stage(pieces(docs, path or vocabulary(), size), "pieces"), size, most_open)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
