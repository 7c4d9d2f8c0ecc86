"""Katz back-off against a brute-force model."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemasight.llm import katz as K


def brute(rows, train, order=2):
    """rows: (id, text). A back-off model written out in plain loops."""
    toks = [[*["<s>"] * (order - 1), *[w.decode("utf-8", "surrogateescape") for w in (t or "").encode().lower().split()], "</s>"] for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]  # by length
    texts = 0
    for (i, _), t in zip(rows, toks, strict=True):
        if train(i):
            texts += 1
            for at in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    counts[n][tuple(t[at - n + 1 : at + 1])] += 1
    uni = counts[1]
    n_tokens, v = sum(uni.values()), len(uni)
    discounts = [None] + [K.good_turing(Counter(c.values())) for c in counts[1:]]

    def worth(n, c):
        return discounts[n][c - 1] if c <= K.RELIABLE else c - K.HALF

    unseen = 1 - sum(worth(1, c) for c in uni.values()) / n_tokens if n_tokens else 1.0
    after, total = defaultdict(list), Counter()
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            after[g[:-1]].append(g[-1])
            total[g[:-1]] += c

    @lru_cache(maxsize=None)
    def weight(context):
        left = 1 - sum(worth(len(context) + 1, counts[len(context) + 1][(*context, w)]) for w in after[context]) / total[context]
        return left / (1 - sum(p(context[1:], w) for w in after[context]))

    def p(context, w):
        if not context:
            return worth(1, uni[w,]) / n_tokens if (w,) in uni else unseen
        if (*context, w) in counts[len(context) + 1]:
            return worth(len(context) + 1, counts[len(context) + 1][(*context, w)]) / total[context]
        return (weight(context) if context in after else 1.0) * p(context[1:], w)

    for a in list(after)[:: max(1, len(after) // 20)]:  # every context's probabilities add up to one
        assert math.isclose(sum(p(a, w) for (w,) in uni) + p(a, object()), 1, rel_tol=1e-9)
    out = []
    for (i, _), t in zip(rows, toks, strict=True):
        own = t[order - 1 :]
        score = sum(math.log10(p(tuple(t[at - order + 1 : at]), t[at])) for at in range(order - 1, len(t)))
        out.append((i, not train(i), len(own), sum((w,) in uni for w in own), n_tokens, sum(math.log10((uni[w,] + 1) / (n_tokens + v + 1)) for w in own), score))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = K.op5_katz(spark, sf).collect()
    same(got, brute(rows, lambda i: not held_out(i)))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_many_small_buckets(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = K.score_texts(docs, train, order=order, chunk=3_000, bucket=1_000).collect()
    same(got, brute(rows, lambda i: not held_out(i), order))


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (None, "A b a B"), (3, "a  b\tc " * 500), ((1 << 62) + 1, "b a")], [(-1, "x y")]])
def test_edges(spark, rows, order):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    same(K.score_texts(df, F.col("doc_id") > 0, order=order).collect(), brute(rows, lambda i: i is not None and i > 0, order))


def test_a_text_longer_than_a_chunk(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.5, n) % 500)) for k, n in enumerate([30_000, 5, 40, 12_000])]
    got = K.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 3, order=3, chunk=1_000, bucket=500).collect()
    same(got, brute(rows, lambda i: i != 3, 3))


def test_numbers_survive_packing():
    rng = np.random.default_rng(0)
    x, y, z = rng.integers(0, 1 << 63, 1000).astype("uint64"), rng.integers(0, 300, 1000).astype("uint64"), np.zeros(1000, "uint64")
    for columns in ([x, y, z], [z], [x[:0]], [y, rng.random(1000).view("uint64")]):
        assert all((a == b).all() for a, b in zip(K.unpacked(K.packed(*columns), len(columns)), columns, strict=True))
    assert (np.cumsum(K.gaps(np.sort(x)), dtype="uint64") == np.sort(x)).all()
