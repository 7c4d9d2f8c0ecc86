"""Removal of repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from schemasight.llm import suffix_dedup as S


def brute(texts, width):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                hit[k : k + width] = True
        spans = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, "u1")[~hit])
        out.append((len(t), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op7_suffix_dedup(spark, sf).collect()}
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], 200), strict=True))
    assert sum(w[1] for w in want.values()) > 0
    assert got == want


@pytest.mark.parametrize("depth", [3, 1000])
def test_suffix_order(depth):
    rng = np.random.default_rng(0)
    for _ in range(150):
        text = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 80)), 0)
        order = S.suffix_order(text, depth).tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [tuple(text[i : i + depth]) for i in order]
        assert keys == sorted(keys)


def test_queues_on_disk_give_the_same_order(monkeypatch):
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 30_000), 0)
    want = S.suffix_order(text, 50)
    monkeypatch.setattr(S, "HELD", 2_000)
    assert (S.suffix_order(text, 50) == want).all()


@pytest.mark.parametrize("stretch", [1, 137, 1000])
def test_long_texts_are_scanned_in_stretches(monkeypatch, stretch):
    """Every window keeps its group and its anchor's place wherever the seams lie, and none is lost or doubled."""
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 5_000, "u1")) + b"x" * 900 + bytes(rng.integers(97, 123, 300, "u1")) * 4

    def windows():
        found = zip(*(x.tolist() for x in S.runs_of(text, 200)), strict=True)
        return [(first + k, group, first + anchor) for group, _, first, n, anchor in found for k in range(n)]

    whole = windows()
    assert [w[0] for w in whole] == list(range(len(text) - 199))
    monkeypatch.setattr(S, "STRETCH", stretch)
    assert windows() == whole


@pytest.mark.parametrize("most", [S.MOST, 3_000, 0])
def test_edges(spark, most):
    """Nulls, short and empty texts, repeated rows, a text that repeats itself, hot passages with many ends, clashing columns; groups split by content once, often or never."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, other = word(300), word(150)
    texts = [None, "", "short", passage, passage, "x" * 1000, word(90) * 8, other + passage, passage + other]
    texts += [word(40) + passage + word(60) for _ in range(20)] + [word(500), word(500)]
    rows = [(k if k % 7 else None, t, "kept", "own", "own") for k, t in enumerate(texts)] + [(3, passage, "kept", "own", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, spans string, _key string")
    out = S.remove_repeats(df, most=most).collect()
    assert {(r.spans, r._key) for r in out} == {("own", "own")}
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(got) == sorted(brute([r[1] for r in rows], 200))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0
