"""SimHash near-dedup against brute force."""

import numpy as np
import pandas as pd
import pytest
import xxhash

from schemasight.llm import simhash as S


def brute(rows):
    fps = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fps, brute_components(fps)


def brute_components(fps):
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], "uint64")
    label = dict(zip(ids, ids, strict=True))
    seen = set()
    for i in ids:
        if i in seen:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            label[x] = i
            near = np.flatnonzero(np.bitwise_count(a ^ np.uint64(fps[x])) <= 3)
            todo += [ids[k] for k in near if ids[k] not in seen]
    return label


def test_whole_table(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps, label = brute(docs)
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def test_every_pair_within_three_bits_shares_a_key_and_survives_its_chain():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            y ^= 1 << int(b)
        shared = [i for i, m in S.keys() if x & m == y & m]
        assert any(len(S.within(i, np.array([x ^ y], "uint64"))) for i in shared)


def test_dense_groups_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 16)
    rng = np.random.default_rng(2)
    fps = {0}
    while len(fps) < 400:
        f = 0x0123456789ABCDEF
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, "uint64").view("int64")}))
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in S.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == brute_components({f: f for f in fps})


@pytest.mark.parametrize("rows", [[], [(1, None, "x")], [(3, "", "x"), (1, None, "x"), (None, " \t", "x"), (2, "a", "x"), (2, "a", "x"), (5, "A b " * 40_000, None)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    want = {0: [], 1: [(1, 1)], 6: [(1, 1), (2, 2), (2, 2), (3, 1), (5, 5), (None, 1)]}[len(rows)]
    assert got == want
