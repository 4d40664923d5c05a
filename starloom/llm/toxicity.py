"""Toxicity by a subsequence string kernel: a support vector machine over Nyström landmarks, trained on labelled texts.

Words (and runs of single letters) are compared by their gap-weighted common subsequences of three
characters, so that an insult with gaps or inserted characters stays close to the plain one. A text's labels say only
that some word is toxic; training therefore picks each toxic text's most telling word anew in every round. A text is
judged by its two most toxic words.

The machine is linear in the kernel's own space, whose axes are the triples of characters. Its landmarks' weights are
summed there once, so that a word's margin is a sum over the word's triples; that equals the sum over landmarks.
"""

from __future__ import annotations

import itertools
import math
import random
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash
from .common import appended, bounded_batches, fold, in_parts, labelled_sample, table, texts_of, trained_in_a_task
from .wordcache import Remembered, blocks, narrow_spaces

DECAY = 0.5
LANDMARKS = 64
LONGEST_LANDMARK = 10
PER_CLASS = 600  # labelled texts of each class at most
LONGEST = 24  # longer words are taken in overlapping parts of this length
THRESHOLD = 0.5
#: Share of toxic texts that scores assume, as the sample's share follows from its classes' bounds; by one word alone.
TOXIC_SHARE, SHARE_ALONE = 0.25, 0.1
LEAST_ODDS, SURE_ODDS = 1.0, 4.0  # log odds from which a beginning or a word counts as telling, or alone tells a text
DOUBT = 2.0  # texts that aren't toxic and that each beginning and word is taken to stand in besides those seen
MOST_ASKED = 2.0  # margin asked of the surest words
_UNSCALED = (1.0, 0.0, 0.0, 0.0, -30.0)
_EDGE = string.punctuation + "¡¿«»“”„…–—"


def words(text: str) -> list[str]:
    """Lower-case words without edge punctuation; three or more single characters in a row make one word."""
    found = text.lower().split()
    if sum(len(w) == 1 for w in found) >= 3:
        merged, run = [], []
        for w in [*found, "  "]:
            if len(w) == 1:
                run.append(w)
                continue
            merged += ["".join(run)] if len(run) >= 3 else run
            run = []
            merged.append(w)
        found = merged[:-1]
    return found


def parts(word: str) -> list[str]:
    """What the kernel sees of a word: its letters and digits; long ones in overlapping parts."""
    word = word.strip(_EDGE)
    if not word.isalnum():
        word = "".join(c for c in word if c.isalnum())
    if len(word) <= LONGEST:
        return [word] if len(word) > 2 else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _array(found: list[str]) -> np.ndarray:
    """Code points, padded with -1; a mark stands before each word."""
    out = np.full((len(found), 1 + max(map(len, found), default=0)), -1, np.int32)
    for i, w in enumerate(found):
        out[i, : len(w) + 1] = [94, *map(ord, w)]
    return out


def _by_length(found: list[str], most: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and codes of equally long words, `most` at once."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(found):
        by_length.setdefault(len(w), []).append(i)
    for where in by_length.values():
        for at in range(0, len(where), most):
            yield where[at : at + most], _array([found[i] for i in where[at : at + most]])


def _sums(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel values of paired rows (arrays broadcast over all but the last axis): subsequences of length 3, each
    weighed by DECAY to the power of what it spans in either word."""
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    n, m = s.shape[-1], t.shape[-1]
    lam, lam2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    # one[j], two[j]: weighted matches of length 1 and 2 in the prefixes s[:i] and t[:j]; they move on with i
    one, two = np.zeros((m + 1, *shape), np.float32), np.zeros((m + 1, *shape), np.float32)
    total = np.zeros(shape, np.float32)
    for i in range(n):
        run1, run2 = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        before1, before2 = one[0].copy(), two[0].copy()
        here = s[..., i]
        for j in range(m):
            same = np.multiply(here == t[..., j], lam2, dtype=np.float32)
            total += same * before2
            run2 *= lam
            run2 += same * before1
            run1 *= lam
            run1 += same
            before1, before2 = one[j + 1].copy(), two[j + 1].copy()
            one[j + 1] *= lam
            one[j + 1] += run1
            two[j + 1] *= lam
            two[j + 1] += run2
    return total


class Machine:
    """Landmarks, their weights, and the scales that turn a text's two greatest margins into a probability."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, scale: tuple[float, ...]):
        self.landmarks, self.weights, self.bias, self.scale = landmarks, weights, bias, scale
        self._t = _array(landmarks)
        self._t[self._t < 0] = -2  # padding equals nothing
        self._norm = np.sqrt([_sums(x, x) for x in (_array([w])[0] for w in landmarks)]).astype(np.float32)
        self._known = Remembered(19, 1, np.float32)
        self._triples: tuple[np.ndarray, np.ndarray] | None = None

    def kernel(self, found: list[str]) -> np.ndarray:
        """Normalised kernel of words (equally long at best) with the landmarks."""
        out = np.zeros((len(found), len(self.landmarks)), np.float32)
        for rows, s in _by_length(found, 128):
            own = np.sqrt(np.maximum(_sums(s, s), 1e-9))
            out[rows] = _sums(s[:, None], self._t[None]) / (own[:, None] * self._norm)
        return out

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each character that landmarks have, from 1; weight of each triple of such numbers)."""
        if self._triples is None:
            letters = sorted({c for w in self.landmarks for c in map(ord, w)} | {94})
            number = np.zeros(letters[-1] + 2, np.int64)
            number[letters] = np.arange(1, len(letters) + 1)
            n = len(letters) + 1
            weight = np.zeros(n**3)
            for w, scale in zip(self.landmarks, self.weights / self._norm, strict=True):
                c = number[[94, *map(ord, w)]]
                for i, j, k in itertools.combinations(range(len(c)), 3):
                    weight[(c[i] * n + c[j]) * n + c[k]] += scale * DECAY ** (k - i + 1)
            self._triples = number, weight.astype(np.float32)
        return self._triples

    def margins(self, found: list[str]) -> np.ndarray:
        """self.kernel(found) @ self.weights + self.bias, by triples."""
        number, weight = self._table()
        n = int(number.max()) + 1
        out = np.full(len(found), self.bias, np.float32)
        for rows, s in _by_length(found, 4096):
            c = number[np.minimum(s, len(number) - 1)].T
            total = np.zeros(len(rows), np.float32)
            for i in range(len(c) - 2):
                for j in range(i + 1, len(c) - 1):
                    pair = (c[i] * n + c[j]) * n
                    for k in range(j + 1, len(c)):
                        total += weight[pair + c[k]] * np.float32(DECAY ** (k - i + 1))
            out[rows] += total / np.sqrt(np.maximum(_sums(s, s), 1e-9))
        return out

    def _chunk_margins(self, chunks: list[str]) -> np.ndarray:
        """The largest margin of each chunk's parts; the bias where it has none."""
        cut = [parts(c) for c in chunks]
        own = list({p for ps in cut for p in ps})
        known = dict(zip(own, self.margins(own).tolist(), strict=True))
        return np.array([max(map(known.__getitem__, ps), default=self.bias) for ps in cut], np.float32)

    def _block(self, texts: list[str]) -> np.ndarray:
        """(texts, 2): the greatest margin of each text's words, and the greatest less than that."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b" ".join(raw) + b" "
        data = np.frombuffer(whole, np.uint8)
        start, end, h = bytehash.words(data, data <= 32)
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
        at = self._known.find(h)
        value = self._known.value[at, 0]
        new, first = np.unique(h[at < 0], return_index=True)
        first = np.flatnonzero(at < 0)[first]
        made = self._chunk_margins([whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        value[at < 0] = made[np.searchsorted(new, h[at < 0])]
        self._known.put(new, made[:, None])
        # Three or more single characters in a row make one more word
        letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        single = (letters[end] - letters[start] == 1).astype(np.int8)
        together = np.concatenate([[False], owner[1:] == owner[:-1]]) & (single > 0) & (np.concatenate([[0], single[:-1]]) > 0)
        runs = np.flatnonzero(together & ~np.concatenate([[False], together[:-1]])) - 1
        lasts = np.flatnonzero(together & ~np.concatenate([together[1:], [False]])) if len(together) else runs
        long = lasts - runs >= 2
        joined = [whole[start[a] : end[b]].decode("utf-8", "surrogatepass").split() for a, b in zip(runs[long], lasts[long], strict=True)]
        owner, value = np.concatenate([owner, owner[runs[long]]]), np.concatenate([value, self._chunk_margins(["".join(j) for j in joined])])
        out = np.full((len(texts), 2), self.bias, np.float32)
        np.maximum.at(out[:, 0], owner, value)
        less = value < out[owner, 0] - 1e-6
        np.maximum.at(out[:, 1], owner[less], value[less])
        return out

    def text_margins(self, texts: list[str]) -> np.ndarray:
        """(texts, 2): the two greatest different margins of each text's words; the bias where it has none."""
        out = np.full((len(texts), 2), self.bias, np.float32)
        for part, owner in blocks([narrow_spaces(t.lower()) for t in texts]):
            for i, m in zip(owner, self._block(part), strict=True):
                out[i] = sorted({*map(float, out[i]), *map(float, m)})[-2:][::-1] if len({*map(float, out[i]), *map(float, m)}) > 1 else m
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """The greater of two fits: by both margins, up to MOST_ASKED, and by the greater margin alone."""
        a, b, c, d, e = self.scale
        m = self.text_margins(texts).astype(np.float64)
        z = np.maximum(np.minimum(m, MOST_ASKED) @ np.array([a, b]) + c, d * m[:, 0] + e)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: np.ndarray, ridge: float = 1e-5, most_steps: int = 50) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge machine by Newton steps; classes weigh alike. asked: the margin
    that each row should have at least."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    each = weight * np.where(y > 0, 0.5 / max(1, weight[y > 0].sum()), 0.5 / max(1, weight[y < 0].sum()))
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    w, active = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(most_steps):
        weighed = x[active] * each[active, None]
        w = np.linalg.solve(weighed.T @ x[active] + keep, weighed.T @ (y * asked)[active])
        now = y * (x @ w) < asked
        if (now == active).all():
            break
        active = now
    return w


def platt(margins: np.ndarray, y: np.ndarray, share: float, steps: int = 3000) -> tuple[float, ...]:
    """Slopes of the columns and offset of a logistic fit, in which toxic rows count as `share` of all."""
    centre, spread = margins.mean(0), margins.std(0) + 1e-9
    z = np.hstack([(margins - centre) / spread, np.ones((len(y), 1))])
    each = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y <= 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= (each * (p - y)) @ z + 1e-3 * np.append(w[:-1], 0)
    slopes = w[:-1] / spread
    return (*map(float, slopes), float(w[-1] - slopes @ centre))


def _variants(word: str, rng: random.Random) -> list[str]:
    """A word with an inserted and with a doubled letter."""
    k, letter = rng.randrange(1, len(word)), rng.choice(string.ascii_lowercase)
    return [word[:k] + letter + word[k:], word[:k] + word[k - 1] + word[k:]]


def _apart(found: list[str], most: int, nearest: float = 0.75) -> list[str]:
    """The first words that aren't close to one before them."""
    out: list[str] = []
    for w in found[: 20 * most]:
        if len(out) < most and (not out or Machine(out, np.zeros(len(out)), 0.0, _UNSCALED).kernel([w]).max() < nearest):
            out.append(w)
    return out


def _beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), LONGEST_LANDMARK) + 1)] + ([word] if 2 < len(word) < 4 else [])


def _odds(toxic: int, fine: int, n: np.ndarray) -> float:
    return math.log((toxic + 0.5) / (n[1] + 1)) - math.log((fine + DOUBT) / (n[0] + 2 * DOUBT))


def _telling(texts: list[list[str]], y: np.ndarray) -> tuple[dict[str, float], list[str]]:
    """(log odds of each beginning of words that three toxic texts or more have; those of LEAST_ODDS or more, in an order
    in which each adds most to the toxic texts that those before it tell)."""
    n = np.bincount(y, minlength=2)
    of = lambda ws: {g for w in ws for g in _beginnings(w)}
    toxic = Counter(g for ws, label in zip(texts, y, strict=True) if label for g in of(ws))
    toxic = {g: c for g, c in toxic.items() if c > 2}
    fine = Counter(g for ws, label in zip(texts, y, strict=True) if not label for g in of(ws) if g in toxic)
    odds = {g: _odds(c, fine[g], n) for g, c in toxic.items()}
    names = sorted(g for g, o in odds.items() if o > LEAST_ODDS)
    place = {g: i for i, g in enumerate(names)}
    held = [[place[g] for g in of(ws) if g in place] for ws, label in zip(texts, y, strict=True) if label]
    where: list[list[int]] = [[] for _ in names]
    for t, gs in enumerate(held):
        for g in gs:
            where[g].append(t)
    left, gain = np.ones(len(held)), np.array([odds[g] * len(where[place[g]]) for g in names])
    order: list[str] = []
    while len(names) and len(order) < 4 * LANDMARKS and gain.max() > 0.5:
        best = int(np.argmax(gain))
        order.append(names[best])
        for t in where[best]:
            for g in held[t]:
                gain[g] -= odds[names[g]] * left[t] * 0.5
            left[t] *= 0.5
        gain[best] = 0
    return odds, order


def train(sample: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 3) -> Machine:
    """A machine from labelled texts; without both classes it finds nothing toxic.

    Landmarks are the most telling beginnings of words, then ordinary words that come nearest to being found toxic.
    """
    rng = random.Random(5)
    texts = [sorted({p for w in set(words(t)) for p in parts(w)}) for t, _ in sample]
    y = np.array([label for _, label in sample])
    if not len(y) or y.min() == y.max():
        return Machine(["xxx"], np.zeros(1), -1.0, (1.0, 0.0, -3.0, 0.0, -30.0))
    odds, order = _telling(texts, y)
    n = np.bincount(y, minlength=2)
    usual, spread = (Counter(w for ws, label in zip(texts, y, strict=True) if label == k for w in ws) for k in (0, 1))
    told = {w: max((odds.get(g, -9.0) for g in _beginnings(w)), default=-9.0) for w in spread}
    told |= {w: min(told[w], _odds(spread[w], usual[w], n)) for w in told if usual[w]}
    asked = lambda w: min(MOST_ASKED, max(0.7, told[w] / 2.2))
    witnesses = [max(ws, key=lambda w: (told[w], w)) for ws, label in zip(texts, y, strict=True) if label and ws]
    drawn = [w for w, _ in usual.most_common(5000)]
    rest = sorted(usual.keys() - set(drawn))
    drawn += rng.sample(rest, min(len(rest), 15_000))
    ordinary = [w for w in reversed(drawn) if len(w) <= LONGEST_LANDMARK]
    chosen = _apart([g for g in order if len(g) > 2], landmarks * 3 // 4, 0.9) or witnesses[:1] or ordinary[:1] or ["xxx"]
    telling = len(chosen)
    chosen += [w for w in ordinary if w not in chosen][: landmarks - telling]
    common = np.sqrt([usual[w] for w in drawn])
    positive = Counter({w: spread[w] for w in spread if told[w] > LEAST_ODDS}) or Counter(witnesses)
    for last in (False, True):
        base = Machine(chosen, np.zeros(len(chosen)), 0.0, _UNSCALED)
        values, vectors = np.linalg.eigh(base.kernel(chosen).astype(np.float64))
        half = vectors[:, values > 1e-3] / np.sqrt(values[values > 1e-3])
        pool = base.kernel(drawn) @ half
        toxic_words = sorted(w for w in spread if told[w] > 1 or w in positive)
        x_toxic = dict(zip(toxic_words, base.kernel(toxic_words) @ half, strict=True))
        hard: dict[int, float] = {}
        for _ in range(rounds):
            plain = [w for w in positive if w in x_toxic]
            more = [(v, positive[w] / 10, asked(w)) for w in sorted(plain, key=lambda w: (-positive[w], w))[:300] if len(w) > 3 for v in _variants(w, rng)]
            x_pos = np.vstack([np.stack([x_toxic[w] for w in plain]), base.kernel([v for v, *_ in more]) @ half]) if plain else np.zeros((0, half.shape[1]))
            held = list(hard)
            x = np.vstack([x_pos, pool, pool[held]])
            weight = np.array([float(positive[w]) for w in plain] + [c for _, c, _ in more] + list(common) + [hard[i] for i in held])
            at_least = np.concatenate([[asked(w) for w in plain], [a for *_, a in more], np.ones(len(x) - len(x_pos))])
            w = _machine(x, np.concatenate([np.ones(len(x_pos)), -np.ones(len(x) - len(x_pos))]), weight, at_least)
            margin = {t: float(v @ w[:-1] + w[-1]) for t, v in x_toxic.items()}
            found = Counter(max(own, key=lambda t: (margin[t], t)) for ws, label in zip(texts, y, strict=True) if label and (own := [t for t in ws if t in margin and told[t] > LEAST_ODDS]))
            positive = Counter({t: max(c, spread[t]) for t, c in (positive | found).items() if margin.get(t, -9) > -0.5}) or positive
            for i in np.argsort(-(pool @ w[:-1]))[:1500]:
                hard[int(i)] = hard.get(int(i), 0) + 5 * common[i]
        if not last:
            # The ordinary words that come nearest to being found toxic take the place of the drawn ones
            nearest = [drawn[i] for i in np.argsort(-(pool @ w[:-1]))]
            chosen = chosen[:telling] + _apart([t for t in nearest if len(t) <= LONGEST_LANDMARK and t not in chosen], landmarks - telling)
    made = Machine(chosen, half @ w[:-1], float(w[-1]), _UNSCALED)
    margins = made.text_margins([t for t, _ in sample]).astype(np.float64)
    # Words that are sure to tell may also stand alone in a text, they or variants of them
    sure = sorted(w for w in spread if told[w] > SURE_ODDS)
    sure = made.margins(sure + [v for w in sure if len(w) > 3 for v in _variants(w, rng)])
    alone = platt(np.concatenate([margins[y == 0, :1], sure[:, None]]), np.repeat([0, 1], [n[0], len(sure)]), SHARE_ALONE) if len(sure) else (0.0, -30.0)
    made.scale = (*platt(np.minimum(margins, MOST_ASKED), y, TOXIC_SHARE), *alone)
    return made


_latest: dict[tuple, Machine] = {}


def _loaded(state: tuple) -> Machine:
    """The machine of a state; a worker keeps the last one, with what it remembers of words."""
    key = (tuple(state[0]), state[1].tobytes(), state[2:])
    if key not in _latest:
        _latest.clear()
        _latest[key] = Machine(*state)
    return _latest[key]


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row. Null and empty texts get the score of no word at all; repeated rows stay, an empty
    table gives none, other columns are not read."""
    state = (machine.landmarks, machine.weights, machine.bias, machine.scale)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(state)
        for part in in_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score(texts_of(part)), pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, score double")


def rated(docs: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """All columns of the rows, and their score, in place of a column of that name if there is one; rows keep their
    places, nothing is joined. Null and empty texts get the score of a text without words; repeated rows stay; an empty
    table gives none."""
    state = (machine.landmarks, machine.weights, machine.bias, machine.scale)
    return appended(docs, name, lambda texts: _loaded(state).score(texts))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """A machine from labelled texts outside fold 0; null and repeated labels as labelled_sample() has it."""
    return trained_in_a_task(labelled_sample(docs, labels, "toxic", per_class), train)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
