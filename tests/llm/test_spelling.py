"""Near words against all pairs, chunks halved again, forms and roots."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from schemasight.llm import spelling as S


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, ratio=2):
    out = []
    of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        if of[w]:
            best = min(of[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * n and words[best] > n:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(of[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def found(spark, words, **more):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.group_variants(df, **more).collect())


@pytest.mark.parametrize("hot", [0, 4, 512])
def test_all_pairs(spark, hot):
    """Crowded chunks are halved until one place is open; nothing is found twice or lost."""
    r = random.Random(hot)
    words = {"".join(r.choices("abé\U0001f600", k=r.randint(1, 7))): r.choice([1, 2, 2, 3, 5, 9, 30]) for _ in range(400)}
    words |= {"": 3, "x" * 2000: 4, "x" * 1999: 9, "x" * 1000 + "y" + "x" * 999: 1}
    assert found(spark, words, hot=hot) == brute(words)


def test_long_chains_lead_to_one_root(spark):
    words = {"abcdef"[:k] + "z" * (12 - k): 3**k for k in range(7)}
    got = found(spark, words)
    assert got == brute(words) and {r[-1] for r in got} == {"abcdefzzzzzz"}


def test_edges(spark):
    rows = [("word", 2), ("word", 3), (None, 9), ("ward", None), ("werd", 5), ("wird", 10), ("weird", 10)]
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in rows], "word string, n long, key string, root int")
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.group_variants(df).collect())
    assert got == brute({"word": 5, "ward": 0, "werd": 5, "wird": 10, "weird": 10})
    assert S.group_variants(df.where("false")).count() == 0


def test_runs(spark):
    docs = [(1, "Würde WÜRDE würde, x×y÷zzz abcde"), (None, "abcde ABCDE"), (7, None), (7, ""), (None, "abcde" * 3000), (3, "naïve—naïve\u0178naïve")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 3 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 4:
                    want[run] = want.get(run, 0) + 1
            run = ""
    got = {r.word: r.n for r in S.runs_of_letters(df, "doc_id", "text", damage=3, shortest=4, least=1).collect()}
    assert got == want
    assert {r.word for r in S.runs_of_letters(df, "doc_id", "text", 3, 4, 3).collect()} == {w for w, n in want.items() if n >= 3}
    assert S.runs_of_letters(df.where(F.lit(False)), "doc_id", "text", 3, 4, 1).count() == 0
