"""Alignment of two tokenizers against a plain loop over tokens."""

import hashlib
import random
from collections import defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from schemasight.llm import align as A


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.PIECES)


def letters():
    """What the byte-level alphabet writes for each byte, as its authors give it."""
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def tokens(coders, text):
    """[(id, start, end)] of both sides, or nothing."""
    if not text:
        return [], []
    a, b = coders
    alphabet, sides = letters(), []
    e = a.encode(" " + text, add_special_tokens=False)
    sides.append([(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)])
    ids = b.encode(text)
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, map(b.id_to_piece, ids), strict=True)])
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return [], []
    out = []
    for side in sides:
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return tuple(out)


def brute(coders, texts):
    per_text, counts = [], defaultdict(int)
    for text in texts:
        a, b = tokens(coders, text)
        links, j = [], 0
        for i, start, end in a:
            while j and b[j][1] > start:
                j -= 1
            while j < len(b) and b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        for pair in set(links):
            counts[pair] += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per_text.append((len(a), len(b), len(groups), links, digest))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(n, m, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), d) for n, m, g, links, d in per_text]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_every_document_against_brute_force(spark, sf, coders):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), brute(coders, [r.text for r in docs]), strict=True))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.op12_alignment(spark, sf).collect()}
    assert got == want


TEXTS = [
    None, "", " ", "a", "a", "a", "A▁b", "▁", "<s> </s> <unk> <|endoftext|> [INST]", "<0x41> <0x0A>\n\r\n\t", "naïve 你好 \U0001f600 é", "x  y   z ", "\x00\x07",
    "no-space" * 50, "hello world\n\nhello", " 　 wide", "q" * 3000, "﻿mark", "it's 'twas don'T", "12 345,678", " \n \n", "ab‍c",
]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
@pytest.mark.parametrize("stretch", [3, 1 << 17])
def test_edges(spark, coders, frequent, stretch, monkeypatch):
    """Nulls, empty texts, copies, control strings, and pairs that are joined instead of broadcast."""
    monkeypatch.setattr(A, "STRETCH", stretch)
    rows = [(None if k % 7 == 3 else k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, own string, pairs int").repartition(3)
    got = sorted((str((r.doc_id, *(r[c] for c in COLUMNS))) for r in A.align_documents(df, frequent=frequent).collect()))
    assert got == sorted(str((i, *w)) for (i, _), w in zip(rows, brute(coders, TEXTS), strict=True))
    assert A.align_documents(df.where("false")).count() == 0


def test_stretches_give_the_ids_of_the_whole(coders, monkeypatch):
    monkeypatch.setattr(A, "STRETCH", 1)
    text = "".join(t or "" for t in TEXTS) * 2
    assert A.byte_level_ids(coders[0], text) == coders[0].encode(text, add_special_tokens=False).ids


def test_a_hot_text_is_dealt_out(spark, coders):
    df = spark.range(30_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'the very same text' else concat('number ', id % 50) end as text")
    out = A.align_documents(df)
    assert out.count() == 30_000
    assert out.groupBy(*COLUMNS).count().where("count = 15000").count() == 1


@pytest.mark.parametrize("stretch", [1, 9, 1 << 17])
@pytest.mark.parametrize("remembered, short", [(0, 64), (20, 3), (1 << 17, 64)])
def test_units_give_the_alignment_of_the_whole(coders, monkeypatch, stretch, remembered, short):
    """Texts of all kinds of white space, contractions and control strings, by units that are remembered, forgotten or too long, against the plain loop."""
    r = random.Random(stretch)
    parts = [" ", "\n", "\t", "\r", "\xa0", "\x1c", "\x85", "　", "  ", "ab", "'s", "12", ".", "é", "你", "\x00", "word", "</s>"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(600)]
    for name, value in (("STRETCH", stretch), ("REMEMBERED", remembered), ("SHORT", short)):
        monkeypatch.setattr(A, name, value)
    both = A.Aligner(A.BYTE_LEVEL, A.PIECES)
    assert both.local
    for text, (n_a, n_b, groups, n_links, *_, digest) in zip(texts, brute(coders, texts), strict=True):
        got = both.align(text)
        assert got[:5] == (n_a, n_b, groups, n_links, digest) and sum(got[6]) == n_links, text


def test_words_are_encoded_once(monkeypatch):
    sent, ids = [], A.byte_level_ids
    monkeypatch.setattr(A, "byte_level_ids", lambda coder, text: sent.append(text) or ids(coder, text))
    both = A.Aligner(A.BYTE_LEVEL, A.PIECES)
    for _ in range(3):
        both.align("the house and the garden\nof the house " * 100)
    assert sum(map(len, sent)) < 100


def test_whole_texts_where_units_can_not_be_cut(coders):
    both = A.Aligner(A.BYTE_LEVEL, A.PIECES)
    both.local = False
    for text, want in zip(TEXTS, brute(coders, [t or "" for t in TEXTS]), strict=True):
        assert both.align(text or "")[:5] == (*want[:4], want[6])
