"""Cross-tokenizer alignment against the tokenizers' own libraries and a plain count of all overlapping tokens."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import SF

from starloom.llm import alignment
from starloom.llm.packing import vocabulary

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["<|endoftext|>", "</s>", "<unk>", "▁", " ", "  ", "\n", "\t", "\r\n", "é", "🎉", "日本語", "́", "a", "The", "ing", "23", "..", "'s", "<0x41>", "\x00", "\x1c", "\x85", "\xa0", "ﬁ", "０", "Σ", "İ"]


def spans(sizes):
    out = []
    for n in sizes:
        out.append((out[-1][1] if out else 0, (out[-1][1] if out else 0) + n))
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    bytes_a = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    total, found = Counter(), []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a, raw_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        if not text or b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        at_a, at_b = spans(map(len, raw_a)), spans(map(len, raw_b))
        links, k = [], 0
        for x, (start, end) in zip(ids_a, at_a):
            while at_b[k][1] <= start:
                k += 1
            links += [(x, y) for y, (s, e) in zip(ids_b[k : k + end - start + 1], at_b[k : k + end - start + 1]) if s < end and e > start]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = []
        i = j = 0
        for cut in cuts:
            i0, j0 = i, j
            while i < len(at_a) and at_a[i][1] <= cut:
                i += 1
            while j < len(at_b) and at_b[j][1] <= cut:
                j += 1
            groups.append(f"{','.join(map(str, ids_a[i0:i]))}|{','.join(map(str, ids_b[j0:j]))}")
        total.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), links, groups))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(d, n, m, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), digest(groups)) for d, n, m, links, groups in found]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    rows = [(1, "The quick brown fox"), (1, "The quick brown fox"), (2, None), (3, ""), (4, "word " * 400_000), (5, "a▁b"), (None, "x y"), (6, " "), (7, "\n"), (8, "a" * 3000)]
    return rows + [(100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30)))) for i in range(1000)]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 40, 0])
def test_odd_texts_with_and_without_the_join(spark, odd, frequent):
    df = spark.createDataFrame([(*r, "x", 3) for r in odd], "doc_id bigint, text string, pairs string, row int")
    assert ordered(tuple(r[c] for c in COLUMNS) for r in alignment.alignments(df, frequent=frequent).collect()) == ordered(brute(odd))


def test_query_on_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(tuple(r[c] for c in COLUMNS) for r in alignment.op13_alignment(spark, SF).collect()) == ordered(brute(rows))


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_identity_map():
    tokens = alignment.loaded(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    joined = [i for i in range(len(tokens.same)) if tokens.same[i] >= 0]
    assert len(joined) > 10_000
    for i in joined:
        piece = tokens.b.text[tokens.same[i]]
        assert tokens.a.raw[i] == (piece.replace("▁", " ").encode() if not re.fullmatch("<0x..>", piece) else bytes([int(piece[3:5], 16)]))
