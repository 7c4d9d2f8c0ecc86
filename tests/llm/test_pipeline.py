"""The pipeline's stages against what each should do, over whole tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from schemasight.llm.shingles import shingles
from tests.llm.test_operators import decontaminated_by_force, jump

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_of_each(rows):
    """The ids that stay of (id, text): the least of each group of texts that chains of shingle similarities of 0.8 or more connect."""
    texts = sorted((i, shingles((t or "").encode())) for i, t in rows)
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
    return {root(i) for i in label}


def mixed_by_force(rows):
    """How often each id is taken of (id, text, source), written out in loops."""
    sizes, members = Counter(), defaultdict(list)
    for i, t, s in rows:
        n = len((t or "").encode().split())
        sizes[s] += n
        key = hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        members[s].append((key, i, n))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, left = {}, set(sizes)
    while left:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= over
    out = Counter()
    for s, docs in members.items():
        before = 0
        for _, i, n in sorted(docs):
            out[i] += sum(k * sizes[s] + before + n / 2 < target[s] for k in range(2))
            before += n
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, items = [], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    first = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {i for i, t in first if t and any(map(str.isalpha, t))} == {r[0] for r in kept[0]}
    assert {r[0] for r in kept[1]} == one_of_each([r[:2] for r in kept[0]]) and len(kept[1]) < len(kept[0])
    clean = [r for r, found in zip(kept[1], decontaminated_by_force([r[:2] for r in kept[1]], items), strict=True) if not found[3]]
    assert sorted(kept[2]) == sorted(clean) and len(clean) < len(kept[1])
    taken = Counter(r[0] for r in kept[3])
    assert taken == +mixed_by_force(kept[2])
    assert sorted(kept[4]) == sorted(kept[3])
    order = {i: k for k, i in enumerate(dict.fromkeys(r[0] for r in kept[3]))}
    for shard in range(16):
        own = sorted((r.slot, r.doc_id) for r in docs.where(f"shard = {shard}").collect())
        assert [s for s, _ in own] == list(range(len(own)))
        assert all(jump(i, 16) == shard for _, i in own)
        firsts = [order[i] for i in dict.fromkeys(i for _, i in own)]
        assert firsts == sorted(firsts)


def test_run_and_null_ids(spark, sf):
    assert C.run(spark, sf).count() > 0
    df = spark.createDataFrame([(None, "the same text here", "en", "a", 1), (None, None, "en", "a", 1), (1, "the same text here", "en", "a", 1), (1, "the same text here", "en", "a", 1)], SCHEMA)
    assert sorted(str(r.doc_id) for r in C.keep_one_of_each(spark, df, sf).collect()) == ["1", "None"]


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_edges_of_stages(spark, sf, name, stage):
    """Empty tables, very long, empty and null texts, repeated and equal rows, nulls in all columns, and columns beside those of documents."""
    rows = [(1, "the cat and the dog " * 40_000, "en", "a", 1), (2, "", "en", None, None), (3, None, None, None, None), (None, None, None, None, None), (4, "a quiet house by the sea", "en", "b", 2), (4, "a quiet house by the sea", "en", "b", 2), (4, "quite another text about rivers", "en", "b", 2)]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA + ", shard string, position int")
    got = stage(spark, df, sf)
    assert got.columns[:5] == C.COLUMNS
    found = got.collect()
    if name == "simhash_dedup":
        assert sorted(len(r.text or "") for r in found) == [0, 24, 31, 800_000]
    if name in ("decontamination", "sharding"):
        assert len(found) == len(rows)
    empty = stage(spark, df.where("false"), sf)
    assert empty.columns[:5] == C.COLUMNS and empty.count() == 0
