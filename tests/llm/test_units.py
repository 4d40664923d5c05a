"""The operators' own parts against plain versions of them."""

import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import bytehash, digest, linecrf, lstmcrf, media, mjpeg, neardup, packing, pieces, pii, toxicity

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


PARTS = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "01.2.3.255", "4994226020900891", "4994-2260 2090 0891", "+1 (743) 555-3824", "+", " ", ".", "-", "é", "\n", "7", "a@b@c.org", "1.2.3.4.5.6.7.8", "%+_", "..", "(", ")"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger():
    return pii.train(["The mail of someone is held by them, said the others at noon. " * 5, "Numbers such as 12 or 3.5 are common in texts that people write about things."], steps=300)


def test_tagger(tagger):
    texts = ["please call (743) 555-3824 today", "write to joe.x (at) mail (dot) com now", "a plain text of 20 words and 3 numbers, no more than that", "", "x" * 500]
    got = [[(lstm, t[s:e]) for s, lstm, e in spans] for t, (_, spans) in zip(texts, pii.all_spans(tagger, texts), strict=True)]
    assert got[0] and got[0][0][0] == 3 and got[1] and got[1][0][0] == 0
    assert got[2:] == [[], [], []]


def test_windows_without_cues_add_nothing(tagger):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS + ["word ", "at ", "dot ", "some more text "]) for _ in range(r.randint(0, 120))) for _ in range(40)]
    kept = lambda spans, t: [s for s in spans if pii.holds(s[1], t[slice(*pii._trim(t, s[0], s[2]))])]
    some, every = pii.tagged(tagger, texts), pii.tagged(tagger, texts, every=True)
    assert [kept(a, t) for a, t in zip(some, texts, strict=True)] == [kept(a, t) for a, t in zip(every, texts, strict=True)]


class Marks:
    """Labels as email what isn't the letter a."""

    def decode(self, c):
        return ((c != lstmcrf.classes_of("a")[0]) & (c != lstmcrf.PAD)).astype(np.uint8), np.ones(c.shape)


def test_long_spans_are_found_at_every_offset(tagger):
    for n in (31, 32, 56, 100):
        span = "q" * (n - 5) + "@m.io"
        assert pii.holds(0, span)
        texts = ["a" * k + span + "a" * 400 for k in range(2 * pii.WINDOW)]
        assert pii.tagged(Marks(), texts) == [[(k, 0, k + n)] for k in range(2 * pii.WINDOW)]
    written = "jonas.winter (at) mail (dot) company (dot) org"
    fill = "the others said that it would be so for many of them and left the house at dawn " * 8
    texts = [fill[:k] + " " + written + " " + fill for k in range(0, 2 * pii.WINDOW, 3)]
    found = [[t[s:e] for s, _, e in spans] for t, (_, spans) in zip(texts, pii.all_spans(tagger, texts), strict=True)]
    assert all(any(written in x for x in f) for f in found)


def test_tagger_gradient():
    t = lstmcrf.Tagger.fresh()
    c, y = pii.training_windows(["some text with a.b@c.de in it and more words"], 4)
    _, grad = t.gradient(c, y)
    for name, at in (("u", (0, 2, 5)), ("x", (1, int(c[0, 5]), 9)), ("change", (0, 1)), ("out", (1, 3, 2))):
        t.w[name][at] += 1e-5
        up = t.gradient(c, y)[0]
        t.w[name][at] -= 2e-5
        down = t.gradient(c, y)[0]
        t.w[name][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, grad[name][at], rel_tol=1e-3, abs_tol=1e-6)


def test_best_set():
    spans = [(0, 0, 5, 3.0), (4, 1, 9, 4.0), (9, 2, 12, 1.0), (0, 0, 5, 3.0)]
    assert pii.best_set(spans) == [(4, 1, 9), (9, 2, 12)]


def test_levels_are_entropies():
    data = np.random.default_rng(1).integers(97, 105, 400).astype(np.uint8)
    for i, level in enumerate(digest.levels(data, block=128)):
        share = np.unique(data[i : i + digest.WINDOW], return_counts=True)[1] / digest.WINDOW
        assert abs(level + 1000 * (share * np.log(share)).sum() / np.log(digest.WINDOW)) <= 1


def test_digests():
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n)).encode() for n in (0, 1, 3, 200, 3000)]
    texts += [texts[3], texts[3][: len(texts[3]) // 2] + texts[4][: len(texts[3]) // 2], b"a" * 500]
    rank = digest.ranks(digest.level_counts(texts))
    whole = digest.digests(texts, rank)
    assert [len(d) == 0 for d in whole] == [True] + [False] * 7
    for text, d in zip(texts, whole, strict=True):
        assert (digest.digests([text], rank)[0] == d).all()
    assert digest.likeness(whole[3], whole[5]) == 1 and digest.likeness(whole[0], whole[0]) == 1 and digest.likeness(whole[0], whole[3]) == 0
    assert digest.likeness(whole[3], whole[4]) < 0.2 < digest.likeness(whole[3], whole[6]) < 0.9


def test_long_texts_have_the_same_digest_in_blocks(monkeypatch):
    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(9000)).encode()
    rank = digest.ranks(digest.level_counts([text]))
    whole = digest.digests([text], rank)[0]
    monkeypatch.setattr(digest, "LONG_BYTES", 5000)
    assert (digest.digests([text, b"short"], rank)[0] == whole).all() and len(whole) > 3
    assert len(digest.digests([b"a" * 20_000], rank)[0]) == 1


def test_range_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abcd--abcd-abce", np.uint8)
    a = bytehash.ranges(bytehash.prefix(data), np.array([0, 6, 11]), np.array([4, 10, 15]))
    assert a[0] == a[1] != a[2]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(raw):
    payload = raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64)
    frames, ms = media.load(media.store(payload))
    assert b"".join(f.tobytes() for f in frames) == payload and ms == 40


def test_other_huffman_tables_and_missing_index():
    frame = np.random.default_rng(3).integers(0, 256, (4, 16)).astype(np.uint8)
    diff = np.zeros((4, 16), int)
    diff[:, 1:] = frame[:, 1:].astype(int) - frame[:, :-1]
    diff[1:, 0], diff[0, 0] = frame[1:, 0].astype(int) - frame[:-1, 0], int(frame[0, 0]) - 128
    counts, symbols = bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))  # nine codes of four bits
    bits = ""
    for d in diff.ravel():
        s = abs(int(d)).bit_length()
        bits += f"{s:04b}" + (f"{int(d) if d >= 0 else int(d) + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    dht = bytes([0xFF, mjpeg.DHT, 0, 19 + len(symbols), 0]) + counts + symbols
    jpeg = mjpeg._head(4, 16)[:2] + dht + mjpeg._head(4, 16)[2 + len(mjpeg._DHT) :] + scan + b"\xff\xd9"
    assert (mjpeg.decode_frame(jpeg) == frame).all()
    avi = mjpeg.write_avi([jpeg], 4, 16)
    assert mjpeg.read_avi(avi) == mjpeg.read_avi(avi.replace(b"idx1", b"junk"))


def test_shots():
    dark, light = np.full((8, 64), 10, np.uint8), np.full((8, 64), 200, np.uint8)
    assert mjpeg.shots([dark] * 5 + [light] * 4 + [dark] * 3) == [(0, 5), (5, 9), (9, 12)]
    assert mjpeg.shots([]) == []


def test_chunk_tokens():
    texts = ["a\x1cb c", "It's  don't x　y <|endoftext|>z ΑΣ Σ é İ 1234 <|startoftext|>", "", "  ", "word. (other), x###. don't! é.", "̸a ̈b \x85q", "steḿ. a.b."]
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    chunks = packing.ChunkTokens(packing.vocabulary())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in chunks.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 8))
def test_best_fit(lengths, most_open):
    placed = packing.place_all(lengths, 50, most_open)
    free, opened, made = {}, [], 0
    for n, (number, offset) in zip(lengths, placed, strict=True):
        fit = min((f for f in free.values() if f >= n), default=None)
        if fit is None:
            if n < 50 and len(free) >= most_open:
                fullest = min(free.values())
                free.pop(next(k for k in reversed(opened) if free.get(k) == fullest))
            assert (number, offset) == (made, 0)
            made += 1
            left = 50 - n
        else:
            assert free[number] == fit and offset == 50 - fit
            left = fit - n
        free.pop(number, None)
        opened = [k for k in opened if k != number]
        if left:
            free[number] = left
            opened.append(number)


def test_pieces_equal_the_library():
    path = packing.vocabulary("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    r = random.Random(1)
    texts = ["Hello  world\n\tx ñ 🎉", "  a   b  ", "▁x", "", "\n", "x" * 100 + "abcdefgh" * 20, "日本語の文章です。 한국어", "def f(x):\n    return x+1\n        pass"]
    texts += ["".join(r.choice("abcdeThis the ing▁ \nñé") for _ in range(200)) for _ in range(60)]
    ids = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode(t) for t in texts]
    assert [model.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]


def test_unigram_pieces_equal_the_library(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(packing.vocabulary("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = pieces.UNIGRAM
    for p in model.pieces:  # distinct sums, so that ties don't decide
        p.score = -math.log(3 + zlib.crc32(p.piece.encode()) % 99991) * 1.37 if p.type == 1 else p.score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(str(path))
    texts = ["The quick brown fox jumps over the lazy dog", "unbelievable internationalisation of things", "a" * 60 + "bcd"]
    for t in texts:
        ids = np.frombuffer(own.encode([t])[0], "<u4").tolist()
        total = lambda x: sum(own.score[i] for i in x)
        assert math.isclose(total(ids), total(library.encode(t)), rel_tol=1e-5)


def exact_similarity(a, b):
    """Probability Jaccard similarity of two weighted sets."""
    return sum(1 / sum(max(a.get(k, 0) / a[i], b.get(k, 0) / b[i]) for k in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probminhash_estimates_probability_jaccard():
    r = random.Random(5)
    a = {i: r.uniform(0.5, 3) for i in range(120)}
    b = {i: a[i] * r.uniform(0.8, 1.25) for i in range(20, 120)} | {i: 1.0 for i in range(200, 220)}
    sets = [a, b, {}]
    owner = np.repeat([0, 1], [len(a), len(b)])
    element = bytehash.mix(np.array([*a, *b], np.uint64) + np.uint64(1))
    got = neardup.probminhash(owner, element, np.array([*a.values(), *b.values()]), len(sets), 4096)
    assert abs((got[0] == got[1]).mean() - exact_similarity(a, b)) < 0.03
    assert not got[2].any()


def test_both_minhashes_equal_separate_ones():
    texts = ["a b c d e f", " ".join("pqrs" * 30), "", " ".join(f"w{k % 40}" for k in range(300)) + " " + " ".join(f"v{k}" for k in range(200)), "x"]
    owner, element, count = neardup.shingles(texts)
    weighted, unit = neardup.both_minhashes(owner, element, count, len(texts), 432)
    assert (weighted == neardup.probminhash(owner, element, 1 + np.log(count), len(texts), 432)).all()
    assert (unit == neardup.probminhash(owner, element, np.ones(len(count)), len(texts), 432)).all()
    assert (weighted[3] != unit[3]).any() and (weighted[0] == unit[0]).all()


def test_shingles():
    texts = ["a b c d e f", "A  b\nc d e\tf", "one two", "", "x y z x y z x y z x y z"]
    owner, element, count = neardup.shingles(texts)
    sets = [set(element[owner == k].tolist()) for k in range(5)]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 1, 0, 3] and sorted(count[owner == 4]) == [2, 3, 3]


def test_kernel_is_the_sum_over_subsequences():
    def plain(s, t, decay):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(t)), 3):
                if [s[k] for k in i] == [t[k] for k in j]:
                    total += decay ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total

    for a, b in (("idiot", "idxiot"), ("abcabc", "bcabca"), ("xyz", "abc")):
        s, t = (toxicity._array([w])[0] for w in (a, b))
        assert math.isclose(float(toxicity._sums(s, t)), plain("^" + a, "^" + b, toxicity.DECAY), rel_tol=1e-5)


def test_margins_by_triples_equal_the_sum_over_landmarks():
    machine = toxicity.Machine(["idiot", "réeux", "loser"], np.array([1.5, -0.7, 2.0]), -0.3, toxicity._UNSCALED)
    found = ["idxiot", "réêou", "loooser", "zzz", "日本語の", "x" * 24, "clown"]
    assert np.allclose(machine.margins(found), machine.kernel(found) @ machine.weights + machine.bias, atol=1e-5)


def test_text_margins_against_plain_ones():
    machine = toxicity.Machine(["idiot", "loser", "clown"], np.array([1.0, 2.0, 1.5]), -0.5, toxicity._UNSCALED)
    texts = ["an Idiot, and\u2003a i d i o t", "", "l o s e r clown", "x y", "a b c d e f loser!", "clown\x85loser " + "word " * 300_000]
    for t, got in zip(texts, machine.text_margins(texts).tolist(), strict=True):
        each = {round(float(m), 4) for w in set(toxicity.words(t)) if (ps := toxicity.parts(w)) for m in [max(machine.margins(ps))]} | {-0.5}
        want = (sorted(each)[-2:] if len(each) > 1 else [*each] * 2)[::-1]
        assert np.allclose(got, want, atol=1e-3), t[:40]


def test_words_and_parts():
    assert toxicity.words("You i d i o t now a b") == ["you", "idiot", "now", "a", "b"]
    assert toxicity.parts("i.d.i.o.t!") == ["idiot"] and toxicity.parts("...") == []
    assert len(toxicity.parts("x" * 60)) == 4


def test_marginals_against_all_paths():
    from itertools import product

    r = np.random.default_rng(7)
    owner, score, change = np.array([0, 0, 0, 2]), r.normal(size=(4, 2)), r.normal(size=(2, 2))
    got, pairs, whole = linecrf.marginals(owner, 3, score, change)
    want, z_all = np.zeros(4), 0.0
    for lines in ([0, 1, 2], [3]):
        weights = {p: math.exp(sum(score[i][s] for i, s in zip(lines, p, strict=True)) + sum(change[a][b] for a, b in zip(p, p[1:], strict=False))) for p in product((0, 1), repeat=len(lines))}
        z = sum(weights.values())
        z_all += math.log(z)
        for k, i in enumerate(lines):
            want[i] = sum(w for p, w in weights.items() if p[k]) / z
    assert np.allclose(got, want) and math.isclose(whole, z_all) and math.isclose(pairs.sum(), 2)


def test_lines():
    owner, size, own = linecrf.lines(["One line.\n\nTwo two TWO!!\nOne line.", "", "x"])
    assert owner.tolist() == [0, 0, 0, 2] and size.tolist() == [9, 13, 9, 1]
    assert own[:, 10].tolist() == [0, 0, 1, 0]
    assert json.dumps(linecrf.lines([])[0].tolist()) == "[]"


def test_bitmaps_of_shingles_never_differ_in_more_bits_than_the_sets_do():
    rng = np.random.default_rng(5)
    base = bytehash.mix(np.arange(3000, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(n)[: n - k]], bytehash.mix(rng.integers(1 << 40, size=k).astype(np.uint64))])) for n, k in ((1, 0), (40, 9), (150, 3), (150, 20), (150, 60), (3000, 900))]
    sets.insert(2, np.zeros(0, np.uint64))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    maps = neardup.parities(owner, np.concatenate(sets), len(sets))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            bits, apart = int(np.bitwise_count(maps[i] ^ maps[j]).sum()), len(np.setxor1d(x, y))
            assert bits <= apart and (bits - apart) % 2 == 0 and (apart > 100 or bits >= 0.8 * apart)
