"""Personal data: patterns with checks, and a character-level BiLSTM-CRF that adds spans that patterns miss.

The tagger is trained from labelled spans: those that the patterns find in a bounded sample of texts, and written-out
or disguised forms placed into such texts. Texts are cut into overlapping windows, each decoded on its own; of all
windows' spans the set of greatest total confidence without overlaps is kept for the whole text. Added spans must
hold what their kind needs (as many digits, a checksum, four parts) and never replace the patterns' spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, in_parts, table, texts_of, trained_in_a_task
from .lstmcrf import KINDS, PAD, Tagger, classes_of

#: Windows overlap by more than the longest span that holds() accepts, with room for edges that are trimmed: each such
#: span is whole, with a character to spare on both sides, in some window.
WINDOW, STRIDE = 256, 128
TRAIN_WINDOW = 64
BATCH = 1024
SAMPLE_TEXTS = 300  # texts with a digit or at-sign from which the tagger learns, of at most SAMPLE_CHARS characters
SAMPLE_CHARS = 20_000
STEPS, TRAIN_BATCH, RATE = 640, 96, 0.015
#: What makes a span certain enough to be added: the mean marginal probability of its label.
LEAST_SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = (ord(d) - 48) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns, leftmost and non-overlapping within a kind; matches that fail their check
    are dropped. Every pattern is anchored so that it takes time in proportion to the text."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            after = m.end()
        else:
            after = max(after, start)
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


#: Written-out marks of an address; a bare "at" counts only beside a written-out dot.
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]", re.I)
_DOT = re.compile(r"\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s", re.I)
_BARE_AT, _WRITTEN_DOT = re.compile(r"\sat\s", re.I), re.compile(r"[\[({<]\s?dot\s?[\])}>]|\sdot\s", re.I)
#: What any span that holds() accepts has in it.
_CUE = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]|\sdot\s", re.I)


def holds(kind: int, span: str) -> bool:
    """Whether an added span has what its kind needs."""
    digits = [c for c in span if "0" <= c <= "9"]
    if kind == 0:
        ways = ((_AT.search(span), _DOT), (_BARE_AT.search(span), _WRITTEN_DOT))
        return len(span) <= 100 and any(m and m.start() > 0 and dot.search(span, m.end()) for m, dot in ways)
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(map(_small, parts)) and len(span) <= 35
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn("".join(digits)) and len(span) <= 60
    return 9 <= len(digits) <= 15 and len(span) <= 40 and len(re.findall("[0-9]+", span)) >= 3


def _parted(rng: random.Random) -> str:
    """What may stand between the groups of a disguised number: a mark or two, with or without blanks or brackets."""
    mark, other = rng.choices("./_|~#,;+-:*=!&^%", k=2)
    return rng.choice([mark, mark, f" {mark} ", f"{mark} ", mark * 2, mark + other, f" {mark}{other} ", f"[{mark}]", f"({mark})", f"<{mark}>", "  ", " "])


def _written(kind: int, rng: random.Random) -> str:
    """A plain or disguised form of a kind."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 8)))
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), ("{at}", "{dot}")])
        at, dot = (at.upper(), dot.upper()) if rng.random() < 0.2 else (at, dot)
        return w() + rng.choice(["", "." + w(), d(2), "." + d(2)]) + at + w() + rng.choice(["", d(1), dot + w()]) + dot + rng.choice(["com", "org", "net", "de"])
    if kind == 1:
        return rng.choice([".", "[.]", " . ", "(.)", "[dot]", " dot ", "(dot)", *(_parted(rng) for _ in range(5))]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        n = d(15)
        n = next(n + c for c in "0123456789" if luhn(n + c))
        return rng.choice(["", " ", "-", "", _parted(rng), _parted(rng), _parted(rng)]).join([n[:4], n[4:8], n[8:12], n[12:]])
    a, b, c = d(3), d(3), d(4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{d(2)} {a} {b} {c}", f"tel:{a}.{b}.{c}"[4:]])


def _plain(rng: random.Random) -> str:
    """Numbers and marks that are no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"{rng.randint(1, 23)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"${d(1)},{d(3)}.{d(2)}", d(rng.randint(1, 6)), d(rng.randint(7, 11)), "".join(rng.choice("0123456789abcdef") for _ in range(20)), f"at {w}" if (w := "noon") and rng.random() < 0.3 else "CC BY-NC 4.0", f"{d(1)} + {d(2)} = {d(2)}", "a.b.c", "see @ 5", f"{d(2)}%"])


def training_windows(texts: list[str], n: int = 8000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(classes, labels) of windows: around the patterns' spans, with forms written in, and of ordinary text."""
    rng = random.Random(seed)
    pool = [t for t in texts if len(t) > 20] or ["the quick brown fox jumps over the lazy dog and runs on "]
    real = [(t, s) for t in pool for s in base_spans(t)]
    x, y = np.full((n, TRAIN_WINDOW), PAD, np.uint8), np.zeros((n, TRAIN_WINDOW), np.int64)
    for k in range(n):
        t, kind = rng.choice(pool), -1
        if k % 4 == 0 and real:
            t, (start, kind, end) = rng.choice(real)
            head, body, tail = t[:start], t[start:end], t[end:]
        else:
            at = rng.randrange(len(t))
            at = t.find(" ", at) + 1 or at
            head, tail = t[:at], t[at:]
            body = ""
            if k % 4 < 3:
                kind = rng.randrange(len(KINDS))
                body = _written(kind, rng)
                tail = rng.choice([" ", ". ", ", ", "\n"]) + tail
            elif rng.random() < 0.6:
                tail = _plain(rng) + " " + tail
        body = body[:TRAIN_WINDOW]
        lead = rng.randint(0, TRAIN_WINDOW - len(body))
        head = head[-lead:] if lead else ""
        window = (head + body + tail)[:TRAIN_WINDOW]
        x[k, : len(window)] = classes_of(window)
        for s, c, e in base_spans(head + " " * len(body) + window[len(head) + len(body) :]):
            y[k, s:e] = c + 1
        if kind >= 0:
            y[k, len(head) : len(head) + len(body)] = kind + 1
    return x, y


def train(texts: list[str], steps: int = STEPS) -> Tagger:
    x, y = training_windows(texts)
    return Tagger.fresh().fit(x, y, steps, TRAIN_BATCH, RATE)


#: The last sample that a tagger was trained from, as hashes of its texts, and that tagger's weights.
_KEPT: dict[tuple[int, ...], dict[str, np.ndarray]] = {}


def trained(docs: DataFrame, most: int = SAMPLE_TEXTS) -> Tagger:
    """A tagger from at most `most` texts that hold a digit or an at-sign, chosen by a hash. The choice is made among
    hashes, which are all that reaches the driver; a task reads the chosen texts and trains. Weights of the same sample
    are kept, as training would find them again. Null texts are left out, repeated ones count once; a table without such
    texts trains from forms written into one fixed sentence."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text", F.xxhash64("text").alias("h"))
    chosen = tuple(r.h for r in some.select("h").distinct().orderBy("h").limit(most).collect())
    if chosen not in _KEPT:
        sample = some.where(F.col("h").isin(*chosen)).groupBy(F.col("h").alias("doc_id")).agg(F.min("text").alias("text"), F.lit(0).alias("y"))
        weights = trained_in_a_task(sample, lambda texts: train([t for t, _ in texts]).w)
        _KEPT.clear()
        _KEPT[chosen] = weights
    return Tagger(_KEPT[chosen])


def best_set(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end, weight) the set without overlaps that weighs most, over the whole text."""
    spans = sorted(set(spans), key=lambda s: (s[2], s))
    ends = [s[2] for s in spans]
    best, take = [0.0] * (len(spans) + 1), []
    for k, (start, _, _, weight) in enumerate(spans):
        before = int(np.searchsorted(ends[:k], start, "right"))
        with_it = best[before] + weight
        take.append((with_it > best[k], before))
        best[k + 1] = max(best[k], with_it)
    out, k = [], len(spans)
    while k:
        use, before = take[k - 1]
        if use:
            out.append(spans[k - 1][:3])
            k = before
        else:
            k -= 1
    return sorted(out)


def tagged(tagger: Tagger, texts: list[str], every: bool = False) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each whole text, reconciled over its windows. A window without a cue has no span that
    holds() could accept, so it needs no decoding; `every` decodes it all the same."""
    rows, where = [], []
    for i, t in enumerate(texts):
        starts = range(0, max(1, len(t) - (WINDOW - STRIDE)), STRIDE) if t else []
        if not every:
            cues = np.array([m.start() for m in _CUE.finditer(t)])
            first = np.searchsorted(cues, np.array(starts, np.int64))
            starts = [s for s, k in zip(starts, first, strict=True) if k < len(cues) and cues[k] < s + WINDOW] if len(cues) else []
        if starts:
            c = classes_of(t)
        for s in starts:
            rows.append(c[s : s + WINDOW])
            where.append((i, s))
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        c = np.full((len(part), WINDOW), PAD, np.uint8)
        for k, r in enumerate(part):
            c[k, : len(r)] = r
        labels, sure = tagger.decode(c)
        for k in np.flatnonzero(labels.any(1)):
            i, s = where[at + k]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], labels[k], [0]])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                b = min(b, len(part[k]))
                # A span cut by its window's edge is left to the neighbour that holds it whole
                cut = (a == 0 and s > 0) or (b == WINDOW and s + WINDOW < len(texts[i]))
                if labels[k, a] and b > a and not cut:
                    certain = float(sure[k, a:b].mean())
                    if certain >= LEAST_SURE:
                        found[i].append((int(s + a), int(labels[k, a]) - 1, int(s + b), round(certain * (b - a), 3)))
    return [best_set(f) for f in found]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and (text[start].isspace() or text[start] in ",;:.\"'"):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ",;:.\"'"):
        end -= 1
    return start, end


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, as (start, kind, end)."""
    out = []
    for text, more in zip(texts, tagged(tagger, texts), strict=True):
        base = base_spans(text)
        added = []
        for start, kind, end in more:
            start, end = _trim(text, start, end)
            if all(end <= s or start >= e for s, _, e in base) and holds(kind, text[start:end]):
                added.append((start, kind, end))
        out.append((base, sorted(base + added)))
    return out


def spans(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<kind, start, end> of each whole text, in code points, by start and then
    kind. Null and empty texts have empty arrays; repeated rows stay; of overlapping added spans the set that weighs most
    stays, of equal ones the first by place; an empty table gives none; other columns are not read."""
    weights = tagger.w

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(weights)
        for part in in_parts(batches, most_bytes=1_000_000):
            got = all_spans(own, texts_of(part))
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x[j]] for x in got], _LIST) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, f"doc_id bigint, base {kind}, spans {kind}")


_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def listed(rows: DataFrame) -> DataFrame:
    """The query's columns of rows (doc_id, base, spans). Counts and digest are of the patterns' spans, which the contract
    fixes; `spans` lists the added ones too."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return listed(spans(docs, trained(docs)))
