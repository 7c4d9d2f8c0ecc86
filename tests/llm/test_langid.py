"""Language ID: the forward pass against all segmentations, and held-out accuracy."""

import math

import numpy as np
import pytest

from schemasight.llm import langid as G

KNOWN = {"": 0, "▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "aba": 6, "bb": 7}
KNOWN = {p[:n]: -1 for p in KNOWN for n in range(1, len(p))} | KNOWN
P = np.random.default_rng(0).dirichlet(np.ones(8), 3).T


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        k = KNOWN.get(word[:n], -1)
        if n == 1 and k < 0:
            k = 0
        if k >= 0:
            for rest in segmentations(word[n:]):
                yield [k, *rest]


@pytest.mark.parametrize("word", ["▁", "▁a", "▁abab", "▁xabbay", "▁" + "ab" * 6])
def test_forward_sums_all_segmentations(word):
    want = np.log(sum(np.prod(P[s], axis=0) for s in segmentations(word)))
    lifted = G.lift(P, KNOWN)
    assert G.log_probabilities([word, "▁b"], KNOWN, lifted)[0] == pytest.approx(want)
    assert G.long_word(word, KNOWN, lifted) == pytest.approx(want)


def test_long_words_stay_in_range():
    lifted = G.lift(P, KNOWN)
    word = "▁" + "abxbb" * 400
    logs = G.log_probabilities([word], KNOWN, lifted)[0]
    assert np.isfinite(logs).all()
    assert logs == pytest.approx(G.long_word(word, KNOWN, lifted))


def test_expected_counts_add_up(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(G, "pieces", lambda path: KNOWN)
    model = G.Model(["x", "y", "z"], P, "")
    got = G.expected(pd.DataFrame({"lang": ["y"], "word": ["▁abab"], "n": [2]}), model)
    found = list(segmentations("▁abab"))
    weight = np.array([math.prod(P[s, 1]) for s in found])
    want = sum(2 * w / weight.sum() * np.bincount(s, minlength=8) for w, s in zip(weight, found, strict=True))
    assert got[:, 1] == pytest.approx(want)
    assert got[:, [0, 2]].sum() == 0


def test_long_words_teach_like_short_ones():
    for word in ("▁abab", "▁xabbay", "▁" + "ab" * 6):
        found = list(segmentations(word))
        weight = np.array([math.prod(P[s, 1]) for s in found])
        want = sum(w / weight.sum() * np.bincount(s, minlength=8) for w, s in zip(weight, found, strict=True))
        piece, share = G.long_counts(word, KNOWN, P[:, 1])
        assert np.bincount(piece, share, 8) == pytest.approx(want)
    piece, share = G.long_counts("▁" + "abxbb" * 400, KNOWN, P[:, 1])
    assert np.isfinite(share).all() and sum(share) > 400


def scored_by_force(text, models):
    """(language, share) of a text by the sum over all segmentations of each word, in plain loops and logarithms."""
    words, logs = G.words_of(text or ""), {}
    if not words:
        return "und", 0.0
    for m in models:
        known = G.pieces(m.vocabulary)
        for lang, p in zip(m.languages, np.log(m.probabilities.T), strict=True):
            logs[lang] = 0.0
            for w in words:
                sums = [0.0] + [-math.inf] * len(w)
                for end in range(1, len(w) + 1):
                    for start in range(end):
                        k = known.get(w[start:end], -1)
                        k = 0 if end - start == 1 and k < 0 else k
                        if k >= 0:
                            sums[end] = np.logaddexp(sums[end], sums[start] + p[k])
                logs[lang] += sums[-1]
    top = max(logs.values())
    best = min(k for k, v in logs.items() if v == top)
    return best, 1 / sum(math.exp(v - top) for v in logs.values())


@pytest.mark.parametrize("most", [64, 1])
def test_scores_against_brute_force(spark, sf, monkeypatch, most):
    """The query's predictions and scores, with all languages in one model and with one in each."""
    monkeypatch.setattr(G, "LANGUAGES", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = G.model_of(spark, docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.op3_language_id(spark, sf).collect()}
    for r in docs.where("n_chars < 400").limit(40).collect():
        lang, share = scored_by_force(r.text, models)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(share, rel=1e-6)


def test_clashing_columns_ties_and_copies(spark):
    rows = [(k, "aa bb", lang, 1, "x") for k, lang in enumerate("qp")] + [(9, "aa bb", None, 2, "y"), (9, "aa bb", None, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _own int, lang_pred string")
    got = G.identify(df, G.train(df))
    assert got.columns == ["doc_id", "text", "lang", "_own", "lang_pred", "score"]
    assert {(r.lang_pred, round(r.score, 6)) for r in got.collect()} == {("p", 0.5)} and got.count() == 4


def test_held_out_accuracy(spark, sf):
    found = {r.doc_id: r for r in G.op3_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    held = [d for d in docs if found[d.doc_id].held_out]
    assert sum(found[d.doc_id].lang_pred == d.lang for d in held) / len(held) >= 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0.0), (2, "le chat et le chien", "fr", 0.0), (3, None, "en", 0.0), (4, "12 !? ²", None, 0.0), (None, "the dog", None, 0.0), (6, "", "fr", 0.0), (7, "the " * 200_000, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in G.identify(df, G.train(df)).collect()]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "en"), (6, "und"), (7, "en")]
    empty = df.where("false")
    assert G.identify(empty, G.train(empty)).count() == 0
    assert {(r.lang_pred, r.score) for r in G.identify(df, G.train(empty)).collect()} == {("und", 0.0)}
