"""What a Python worker remembers of words, in tables of a fixed size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Texts are worked on in blocks of about so many characters, cut where a word begins.
BLOCK = 400_000


class Remembered:
    """Values of words by the 64-bit hashes of the words. Every hash has two places; a new word takes a free one, or
    drives out what stands in the second. So memory is bounded whatever words come."""

    def __init__(self, bits: int, width: int, kind: type):
        self._bits, self._mask = bits, np.uint64((1 << bits) - 1)
        self._key, self.value = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, width), kind)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & self._mask).astype(np.int64), ((h >> np.uint64(self._bits)) & self._mask).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes; -1 where one isn't known."""
        a, b = self._places(h)
        at = np.where(self._key[a] == h, a, b)
        return np.where(self._key[at] == h, at, -1)

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        """Enter distinct hashes; of those that want one place one is entered."""
        a, b = self._places(h)
        at = np.where(self._key[a] == 0, a, b)
        self._key[at] = h
        own = self._key[at] == h
        self.value[at[own]] = value[own]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers of it, then those of the next."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class IdLists:
    """Lists of ids by the hashes of words; lists of over `width` ids aren't remembered."""

    def __init__(self, bits: int = 19, width: int = 7):
        self._width, self._table = width, Remembered(bits, width + 1, np.uint32)

    def of(self, h: np.ndarray, fresh: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in a row). fresh: the same for the words at the given places, which are
        distinct and not known."""
        at = self._table.find(h)
        hit, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        _, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
        first = missing[first]
        new_count, new_ids = fresh(first)
        new_start = np.cumsum(new_count) - new_count
        rows = self._table.value[at[hit]]
        count = np.empty(len(h), np.int64)
        count[hit], count[missing] = rows[:, 0], new_count[inverse]
        end = np.cumsum(count)
        start = end - count
        out = np.empty(end[-1] if len(h) else 0, np.uint32)
        for k in range(self._width):
            long = rows[:, 0] > k
            out[start[hit][long] + k] = rows[long, k + 1]
        out[spread(start[missing], count[missing])] = new_ids[spread(new_start[inverse], count[missing])]
        short = new_count <= self._width
        entry = np.zeros((int(short.sum()), self._width + 1), np.uint32)
        entry[:, 0] = new_count[short]
        for k in range(self._width):
            long = entry[:, 0] > k
            entry[long, k + 1] = new_ids[new_start[short][long] + k]
        self._table.put(h[first][short], entry)
        return count, out


def narrow_spaces(text: str) -> str:
    """The text with a space for each run of white space beyond ASCII."""
    return text if text.isascii() else _WIDE_SPACE.sub(" ", text)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of texts of about `size` characters, and which text each belongs to. A longer text is cut in parts, each
    from a space on (U+0020) that follows another character."""
    held, owner, n = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > size:
                end = t.find(" ", at + size)
                while end > 0 and t[end - 1] == " ":
                    end = t.find(" ", end + 1)
                end = end if end > 0 else len(t)
            if n and n + end - at > size:
                yield held, owner
                held, owner, n = [], [], 0
            held.append(t[at:end])
            owner.append(i)
            n += end - at
            at = end
    if held:
        yield held, owner


def by_text(owner: list[int], size: np.ndarray, ids: np.ndarray, out: list[bytes]) -> None:
    """Add the ids of a block's parts, of the given sizes, to the texts that they belong to."""
    end = np.cumsum(size)
    for i, a, b in zip(owner, end - size, end, strict=True):
        own = ids[a:b].astype("<u4", copy=False).tobytes()
        out[i] = out[i] + own if out[i] else own
