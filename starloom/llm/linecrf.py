"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbours; forward and backward sums give each
line's marginal, and the marginals' length-weighted mean and its worst part make the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import appended, bounded_batches, fold, in_parts, labelled_sample, table, texts_of, trained_in_a_task

PER_CLASS = 700  # labelled texts of each class at most
THRESHOLD = 0.3
_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _STOP, _HIGH = 1, 2, 4, 8, 16, 32, 64
#: Class of each byte; bytes from 128 are parts of letters here.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        _LETTER | _HIGH if _b >= 128 else _LETTER | _UPPER if _c.isupper() else _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _SPACE if _b <= 32 else _STOP if _c in ".,;:'\"()-?" else _MARK
    )


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bytes, features) of each line that isn't blank. Features: log length, shares of letters, capitals,
    digits, stops and other marks, whether marks end the words, mean word length, shares of words that repeat the one
    before and of words met before in the line, and whether the line itself stood before in the text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    limit = np.cumsum([len(r) + 1 for r in raw])
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    kind = _CLASS[data]
    blank = np.add.reduceat(kind & _SPACE == 0, start)[: len(start)] == 0 if len(start) else np.zeros(0, bool)
    word_start, word_end, word = bytehash.words(data, data <= 32)
    keep = ~blank
    start, end = start[keep], end[keep]
    owner = np.searchsorted(limit, start, "right")
    size = np.maximum(1, end - start)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[end] - sums[start]

    line = np.searchsorted(start, word_start, "right") - 1
    n_words = np.maximum(1, np.bincount(line, minlength=len(start)))
    tail = kind[word_end - 1] & _MARK > 0
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
    order = np.lexsort((word, line))
    again = np.concatenate([[False], (word[order][1:] == word[order][:-1]) & (line[order][1:] == line[order][:-1])]) if len(order) else np.zeros(0, bool)
    of_line = lambda flags, where: np.bincount(where, flags, minlength=len(start)) / n_words
    text = bytehash.ranges(bytehash.prefix(data), start, end)
    by = np.lexsort((np.arange(len(text)), text, owner))
    seen = np.zeros(len(text))
    if len(by):
        seen[by[1:]] = (text[by][1:] == text[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    letters = np.maximum(1, total(kind & _LETTER > 0))
    columns = [
        np.log(size), letters / size, total(kind & _UPPER > 0) / letters, total(kind & _DIGIT > 0) / size, total(kind & _STOP > 0) / size, total(kind & _MARK > 0) / size,
        of_line(tail, line), np.log(size / n_words), of_line(same, line), of_line(again, line[order]), seen, n_words == 1,
    ]
    return owner, size, np.stack(columns, 1).astype(np.float64) if len(start) else np.zeros((0, len(columns)))


def neighbours(owner: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A line's features, a few of them squared, those of the line before and after (zeros at the ends), and one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (owner[1:] == owner[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    first = np.ones(len(owner))
    if len(owner):
        first[1:] = owner[1:] != owner[:-1]
    return np.hstack([own, own[:, 1:11] ** 2, before, after, first[:, None], np.ones((len(own), 1))])


def _grid(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each line in its text, and the number of lines of each text."""
    each = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - (np.cumsum(each) - each)[owner], each


def marginals(owner: np.ndarray, n: int, score: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(each line's probability of state 1, expected transitions (2, 2), log partition). score: (lines, 2); texts go
    through the chain side by side, the longest first, so that at each place those that have ended drop off."""
    place, each = _grid(owner, n)
    order = np.argsort(-each, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    longest = int(each.max()) if n else 0
    live = np.searchsorted(-each[order], -np.arange(longest), "left")
    by = np.lexsort((rank[owner], place))
    first = np.concatenate([[0], np.cumsum(live)])
    s = score[by]
    ahead = np.empty_like(s)
    for t in range(longest):
        a, b = first[t], first[t + 1]
        if not t:
            ahead[a:b] = s[a:b]
        else:
            p = ahead[first[t - 1] : first[t - 1] + b - a]
            ahead[a:b] = s[a:b] + np.logaddexp(p[:, :1] + change[0], p[:, 1:] + change[1])
    behind, pairs = np.zeros_like(s), np.zeros((2, 2))
    norm = np.zeros(len(s))
    for t in range(longest - 1, -1, -1):
        a, b = first[t], first[t + 1]
        if t + 1 < longest:
            c, d = first[t + 1], first[t + 2]
            m = d - c
            nxt = s[c:d] + behind[c:d]
            behind[a : a + m] = np.logaddexp(change[:, 0] + nxt[:, :1], change[:, 1] + nxt[:, 1:])
        norm[a:b] = np.logaddexp.reduce(ahead[a:b] + behind[a:b], axis=1)
        if t + 1 < longest:
            z = norm[a : a + m, None, None]
            pairs += np.exp(ahead[a : a + m, :, None] + change + nxt[:, None, :] - z).sum(0)
    out = np.empty(len(s))
    out[by] = np.exp(ahead[:, 1] + behind[:, 1] - norm)
    return out, pairs, float(norm[: live[0]].sum()) if longest else 0.0


class LineField:
    """Feature scale, weights of state good (bad has none), transitions, and the document's logistic weights."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, change: np.ndarray, final: np.ndarray):
        self.centre, self.spread, self.weights, self.change, self.final = centre, spread, weights, change, final

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, bytes, probability of good) of each line."""
        owner, size, own = lines(texts)
        x = (neighbours(owner, own) - self.centre) / self.spread
        score = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        return owner, size, marginals(owner, len(texts), score, self.change)[0]

    @staticmethod
    def summary(owner: np.ndarray, size: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
        """Of each text: the log odds of the length-weighted mean marginal, the mean itself, the log of the expected
        bad bytes, whether it has any line, and one."""
        total = np.bincount(owner, size, minlength=n)
        bad = np.bincount(owner, size * (1 - good), minlength=n)
        mean = np.where(total > 0, 1 - bad / np.maximum(total, 1), 0.5)
        odds = np.log(np.clip(mean, 1e-4, 1) / np.clip(1 - mean, 1e-4, 1))
        return np.stack([odds, mean, np.log1p(bad), (total > 0).astype(float), np.ones(n)], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.summary(*self.lines(texts), len(texts)) @ self.final
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(sample: list[tuple[str, int]], rounds: int = 3, steps: int = 120) -> LineField:
    """Fit the field to labelled texts. All lines of a good text are good. Those of a bad text count as bad at first;
    after each round a bad text's lines are labelled by their marginals, but its worst line stays bad."""
    texts = [t for t, _ in sample] or [""]
    y = np.array([label for _, label in sample] or [1])
    owner, size, own = lines(texts)
    x = neighbours(owner, own)
    centre, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    centre[-1], spread[-1] = 0, 1
    x = (x - centre) / spread
    state = y[owner].astype(float)
    share = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])[y] * len(y)
    place, each = _grid(owner, len(texts))
    follows = place > 0
    k = x.shape[1]
    w = np.zeros(k + 4)
    for _ in range(rounds):
        now = state.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (now[:-1][follows[1:]], now[1:][follows[1:]]), 1.0)
        weight = share[owner] / np.sqrt(each[owner])

        def grad(w: np.ndarray) -> np.ndarray:
            change = w[k:].reshape(2, 2)
            p, pairs, _ = marginals(owner, len(texts), np.stack([np.zeros(len(x)), x @ w[:k]], 1), change)
            return np.concatenate([x.T @ (weight * (p - state)) / len(y) + 1e-3 * w[:k], ((pairs - seen) / max(1, len(x)) + 1e-2 * change).ravel()])

        w = _adam(grad, w, steps, 0.05)
        good = marginals(owner, len(texts), np.stack([np.zeros(len(x)), x @ w[:k]], 1), w[k:].reshape(2, 2))[0]
        worst = np.full(len(texts), np.inf)
        np.minimum.at(worst, owner, good)
        state = np.where(y[owner] == 1, 1.0, ((good > 0.5) & (good > worst[owner])).astype(float))
    field = LineField(centre, spread, w[:k], w[k:].reshape(2, 2), np.zeros(5))
    z = field.summary(owner, size, good, len(texts))
    even = np.array([0.5 / max(1, (y == c).sum()) for c in (0, 1)])[y]

    def grad(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return z.T @ (even * (p - y)) + 1e-4 * w

    field.final = _adam(grad, np.zeros(5), 1500, 0.05)
    return field


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineField:
    """A field from labelled texts outside fold 0; null and repeated labels as labelled_sample() has it."""
    return trained_in_a_task(labelled_sample(docs, labels, "quality", per_class), train)


def _state(field: LineField) -> tuple:
    return field.centre, field.spread, field.weights, field.change, field.final


def scored(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id and score of each row. Null and empty texts have no lines and get the fit's score for that; repeated rows
    stay, an empty table gives none, other columns are not read."""
    state = _state(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineField(*state)
        for part in in_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score(texts_of(part)), pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, score double")


def rated(docs: DataFrame, field: LineField, name: str = "quality_score") -> DataFrame:
    """All columns of the rows, and their score, in place of a column of that name if there is one. Null and empty texts
    get the score of a text without lines; repeated rows stay; an empty table gives none."""
    state = _state(field)
    return appended(docs, name, lambda texts: LineField(*state).score(texts))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
