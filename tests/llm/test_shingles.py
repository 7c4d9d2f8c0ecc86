"""Near-duplicates by shingles against brute force, on planted copies at 0.8 to 1."""

import numpy as np
import pytest

import corpus_pipeline as C
from schemasight.llm import shingles as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(x, y):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def planted():
    """Texts with copies, each with some words replaced: (text, copy, similarity)."""
    rng, out = np.random.default_rng(8), []
    for k in range(200):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        copy = list(words)
        for at in rng.choice(300, 1 + k % 12, replace=False):
            copy[at] = f"v{k}"
        out.append((" ".join(words), " ".join(copy), similarity(" ".join(words), " ".join(copy))))
    return out


@pytest.mark.parametrize("few, most, held", [(16, 1 << 12, 1 << 20), (1, 1 << 12, 1 << 20), (1, 2, 1 << 20), (1, 1 << 12, 300)])
def test_planted_copies(spark, sf, monkeypatch, few, most, held):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "HELD", held)
    pairs = planted()
    rows = [(2 * k + n, t, "en", "a", 1) for k, p in enumerate(pairs) for n, t in enumerate(p[:2])]
    got = {r.doc_id for r in C.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    want = {2 * k for k in range(len(pairs))} | {2 * k + 1 for k, p in enumerate(pairs) if p[2] < 0.8}
    assert got == want
    assert sum(0.8 <= p[2] < 0.9 for p in pairs) > 40 and sum(0.9 <= p[2] < 1 for p in pairs) > 40


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r.doc_id, np.array(S.shingles((r.text or "").encode()))) for r in docs.select("doc_id", "text").distinct().collect())
    label = {i: i for i, _ in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, x) in enumerate(texts):
        for j, y in texts[:k]:
            n = len(np.intersect1d(x, y))
            if 5 * n >= 4 * (len(x) + len(y) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    want = {root(i) for i in label}
    assert {r.doc_id for r in C.keep_one_of_each(spark, docs, sf).collect()} == want
    assert len(want) < len(label)


def test_stage_links_by_fingerprints_first(spark, sf, monkeypatch):
    """Pairs within 3 bits are linked by SimHash and pigeonring alone, if their sets are similar, and the stage goes through it."""
    called, links = [], S.simhash.links
    monkeypatch.setattr(S.simhash, "links", lambda fps: called.append(1) or links(fps))
    texts = [t for p in planted() for t in p[:2]] + ["", "a b", "a b", "c d"]
    fps = [S.simhash.folded(S.shingles(t.encode()).astype("<u8")) for t in texts]
    near = [k for k in range(0, 400, 2) if (fps[k] ^ fps[k + 1]).bit_count() <= 3]
    want = {frozenset((texts[k], texts[k + 1])) for k in near if similarity(texts[k], texts[k + 1]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    rows = S.settle(df.select("key", S.sketch(S.F.col("text")).alias("s")).select("key", "s.*"))
    sig = {r.sig: texts[r.key] for r in rows.collect()}
    got = {frozenset((sig[r.a], sig[r.b])) for r in S.close_links(rows, df).collect()}
    assert got == want and len(want) > 10 and called
    called.clear()
    assert C.keep_one_of_each(spark, spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SCHEMA), sf).count() and called
