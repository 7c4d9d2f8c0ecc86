"""Sharding, line dedup, mixing, token counts, embeddings and decontamination: whole tables and edge cases."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from schemasight.llm import decontaminate as D
from schemasight.llm import embed_graph as E
from schemasight.llm import line_dedup as L
from schemasight.llm import mixing as M
from schemasight.llm import sharding as S
from schemasight.llm import token_counts as K
from schemasight.llm.common import components
from schemasight.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    order = lambda d: d[columns].sort_values(next(c for c in ("doc_id", "conv_id", "word") if c in columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)


def jump(key, n):
    b = j = 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = S.op1_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shard_edges(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (-5, "b"), (7, "c"), (7, "c"), (7, "d")]
    df = spark.createDataFrame([(i, t, 99) for i, t in rows], "doc_id long, text string, shard int")
    got = S.shard_documents(df, "doc_id", 3, ["text"]).collect()
    assert len(got) == 7 and len({(r.shard, r.slot) for r in got}) == 7
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and all(0 <= r.shard < 3 for r in got)
    assert S.shard_documents(df.where("false"), "doc_id", 3, ["text"]).count() == 0
    named = spark.createDataFrame([("x",), (None,)], "doc_id string")
    assert {r.shard for r in S.shard_documents(named, "doc_id", 1, []).collect()} == {0}
    with pytest.raises(ValueError):
        S.shard_of(F.lit(1), 0)


def test_line_edges(spark):
    many = [(k, f"Shared \nown {k}\n\n shared", "x") for k in range(4)]
    rows = [*many, (None, None, "x"), (None, "shared", "x"), (9, "", "x"), (9, "", "x"), (10, "SHARED\n" * 3, "x"), (11, "own 1\nÉ", "x"), (12, "é\n" * 30_000 + "shared", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.dedup_lines(df, min_docs=5).collect()), key=str)
    want = [*[(k, 4, 2, f"own {k}\n") for k in range(4)], (None, 1, 0, ""), (None, 1, 1, ""), (9, 1, 0, ""), (9, 1, 0, ""), (10, 4, 3, ""), (11, 2, 0, "own 1\nÉ"), (12, 30_001, 1, "\n".join(["é"] * 30_000))]
    assert got == sorted(want, key=str)
    assert L.dedup_lines(df.where("false")).count() == 0


def test_a_document_is_a_row(spark):
    """Three rows with one id are three documents, in the operator and in its SQL."""
    rows = [(1, "same\nown a"), (1, "same\nown b"), (1, "same\nown a"), (2, "other")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, _key int, _lines int, _lost int")
    got = L.dedup_lines(df, min_docs=3)
    assert got.columns == [*df.columns, "n_lines", "n_dropped", "kept_text"]
    assert sorted(r.kept_text for r in got.collect()) == ["other", "own a", "own a", "own b"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    sql = L.OP6_SQL.replace(">= 10", ">= 3")
    assert sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped FROM ({sql})").fetchall()) == sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got.collect())


@pytest.mark.parametrize("name", ["rank", "from", "to", "_source", "_rank", "_before", "_start", "_bucket", "_digest", "position", "weight"])
def test_columns_of_any_name_stay(spark, name):
    rows = [(k, "ab"[k % 2], "w " * k, "own") for k in range(20)]
    df = spark.createDataFrame(rows, f"doc_id long, source string, text string, `{name}` string").withColumn("size", M.word_count(F.col("text"))).withColumn("key", M.mixing_key(F.col("doc_id"), F.col("text")))
    for got in (M.plan_mix(df), S.shard_documents(df, "doc_id", 3, ["text"]), S.shard_in_order(df, "doc_id", 3)):
        assert got.columns[: len(df.columns)] == df.columns
        assert {r[name] for r in got.collect()} == {"own"}
    assert {r[name] for r in M.mix(df).collect()} == {"own"} or name == "position"


def test_order_of_the_curriculum_survives_sharding(spark, tmp_path):
    rows = [(k, "ab"[k % 2], "w " * (k % 9)) for k in range(300)] + [(None, "b", "w w"), (None, "b", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", M.word_count(F.col("text"))).withColumn("key", M.mixing_key(F.col("doc_id"), F.col("text")))
    M.mix(df).write.parquet(str(tmp_path / "mixed"))
    got = S.shard_in_order(spark.read.parquet(str(tmp_path / "mixed")), "doc_id", 4).collect()
    for shard in range(4):
        own = sorted((r.slot, r.position) for r in got if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        assert [p for _, p in own] == sorted(p for _, p in own)
    empty = spark.createDataFrame([], "doc_id long, slot int")
    assert S.shard_in_order(empty, "doc_id", 4).count() == 0


def test_rows_of_one_position_are_dealt_out(spark):
    """Most rows have no words, or no position: no range holds them all, and the order is whole."""
    rows = [(k, "a" if k % 2 else "b", "w" if k % 50 == 0 else "") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", M.word_count(F.col("text"))).withColumn("key", M.mixing_key(F.col("doc_id"), F.col("text")))
    placed = M.mix(df).select("position", "key").union(df.select(F.lit(None).cast("double"), "key")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.in_training_order(placed, "position", "key").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == placed.count() > 4000
    assert max(Counter(r.part for r in got).values()) < len(got) / 3
    order = [(r.position is None, r.position or 0, r.key) for r in sorted(got, key=lambda r: r.part)]
    assert order == sorted(order)


def test_long_texts_are_sized_and_sharded(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, None, None)], "doc_id long, text string, source string")
    sized = df.withColumn("size", M.word_count(F.col("text"))).withColumn("key", M.mixing_key(F.col("doc_id"), F.col("text")))
    assert {r.doc_id: r.size for r in M.plan_mix(sized).collect()} == {1: 400_000, 2: 0}
    assert S.shard_documents(df, "doc_id", 2, ["text"]).count() == 2


def test_mix_edges(spark):
    rows = [(k, "a" if k % 3 else None, "w " * (k % 7)) for k in range(60)] + [(99, "b", None), (5, "c", "x y"), (5, "c", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", M.word_count(F.col("text"))).withColumn("key", M.mixing_key(F.col("doc_id"), F.col("text"))).withColumn("target", F.lit("x"))
    got = M.plan_mix(df).collect()
    assert len(got) == len(rows)
    total, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        assert target[s] <= 2 * total[s] and abs(taken[s] - target[s]) <= largest[s]
    mixed = M.mix(df).collect()
    assert len(mixed) == sum(r.copies for r in got)
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    assert M.plan_mix(df.where("false")).count() == 0


def test_token_counts_tile_the_text(spark, sf):
    rows = K.op4_token_counts(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coder, _ = K.encoding(K.VOCABULARY, K.PATTERN)
    for r in rows:
        assert r.n_tokens == len(coder.encode_ordinary(texts[r.doc_id])) == sum(r.section_tokens)
    assert sum(r.n_crossing for r in rows) > 0


def test_section_tokens_against_brute_force(spark, sf):
    """The query's numbers by section: each token read back as bytes, its first byte looked up among the sentences' bytes."""
    rows = {r.doc_id: r for r in K.op4_token_counts(spark, sf).collect()}
    coder, _ = K.encoding(K.VOCABULARY, K.PATTERN)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        got, text = rows[r.doc_id], r.text
        if text is None:
            assert (got.n_tokens, got.n_sections, list(got.section_tokens)) == (0, 0, [])
            continue
        owner, section = [], 0
        for k, c in enumerate(text):
            owner += [section] * len(c.encode())
            section += c == "\n" or c == " " and k > 0 and text[k - 1] in ".!?"
        want, crossing, at = [0] * (owner[-1] + 1 if owner else 1), 0, 0
        for token in coder.encode_ordinary(text):
            n = len(coder.decode_single_token_bytes(token))
            want[owner[at]] += 1
            crossing += owner[at] != owner[at + n - 1]
            at += n
        have = list(got.section_tokens)
        assert have[: len(want)] == want and not any(have[len(want) :])
        assert (got.n_tokens, got.n_crossing, got.most_tokens) == (sum(want), crossing, max(want))


@pytest.mark.parametrize("rule", K.RULES)
def test_attribution_against_bytes(rule):
    rng = np.random.default_rng(4)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 6, rng.integers(1, 12)))
        cuts = np.sort(rng.integers(0, ends[-1] + 1, rng.integers(0, 5)))
        bounds = np.concatenate([[0], cuts, [ends[-1]]])
        got, crossing = K.attribute(ends, bounds, rule)
        want, across = np.zeros(len(bounds) - 1), 0
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            where = [int(np.searchsorted(bounds, x, "right")) - 1 for x in range(a, b)]
            across += len(set(where)) > 1
            share = Counter(where)
            if rule == "split":
                for s, n in share.items():
                    want[s] += n / (b - a)
            else:
                want[{"first": where[0], "last": where[-1], "most": max(share, key=lambda s: (share[s], -s))}[rule]] += 1
        assert got == pytest.approx(want) and crossing == across


def test_token_edges(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("", [3]), ("héllo wörld", [2, None, 100]), ("abc", []), ("x" * 50_000, [1])], "text string, w array<int>").withColumn("n_tokens", F.lit("x"))
    got = K.count_tokens(df, "text", "w", "last").collect()
    assert [len(r.section_tokens) for r in got] == [0, 1, 1, 3, 1, 2]
    negative = spark.createDataFrame([("abc def", [2, -5, 3])], "text string, w array<int>")
    assert [len(r.section_tokens) for r in K.count_tokens(negative, "text", "w").collect()] == [4]
    assert all(sum(r.section_tokens) == r.n_tokens for r in got)
    with pytest.raises(ValueError):
        K.count_tokens(df, "text", "w", "none")
    empty = K.count_tokens(df.limit(0), "text", "w")
    assert empty.columns == ["text", "w", "n_tokens", "n_crossing", "section_tokens"] and empty.count() == 0


def test_tokens_of_a_very_long_text(spark):
    text = "A line of words, 12 of them. And ünïcode!\n" * 60_000  # 2.6 million bytes
    df = spark.createDataFrame([(text, [len(text) // 2])], "text string, w array<int>")
    got = K.count_tokens(df, "text", "w").first()
    one = K.count_tokens(spark.createDataFrame([(text[: len(text) // 60_000], None)], "text string, w array<int>"), "text", "w").first()
    assert got.n_tokens == 60_000 * one.n_tokens and list(got.section_tokens) == [got.n_tokens / 2] * 2


def embeddings_by_force(rows, least=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= least] for i in good}
    out = {}
    for i, _ in rows:
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links.get(x, [])
        out[i] = (len(links.get(i, [])), min(seen), min(seen) == i)
    return out


def test_embeddings_with_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD", 60)
    monkeypatch.setattr(E, "MOST", 90)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[0] + rng.normal(scale=0.15, size=(150, 16))), *(base[1] + rng.normal(scale=0.25, size=(100, 16))), *([base[2]] * 30)]
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    want = embeddings_by_force(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert E.near_duplicates(df.where("false")).count() == 0


def test_embeddings_across_shards(spark, monkeypatch):
    """Links between vectors that share no cluster are found along united lists, and none is counted twice."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 8))
    vectors = np.concatenate([base + rng.normal(scale=0.12, size=base.shape) for _ in range(12)])
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    monkeypatch.setattr(E, "SHARD", 40)
    df = spark.createDataFrame([(k if k % 5 else None, v) for k, v in rows] + [(7, rows[7][1])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links) for r in E.near_duplicates(df).where("vec_id is not null").collect())
    force = embeddings_by_force([*rows, (10_000, rows[7][1])])
    want = sorted([(k, force[k][0]) for k, _ in rows if k % 5] + [(7, force[10_000][0])])
    right = sum(g == w for g, w in zip(got, want, strict=True))
    assert right >= 0.97 * len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_embeddings_isolated_pairs(spark, monkeypatch):
    """Vectors whose only link is to each other, just above the threshold, are found although clusters are small, and the recall is told."""
    monkeypatch.setattr(E, "SHARD", 40)
    rng = np.random.default_rng(3)
    a, z = rng.normal(size=(2, 1000, 128))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = E.near_duplicates(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(k, 1, k % 1000) for k in range(2000)}
    assert {r.recall for r in got} == {1.0}


def test_embeddings_audit(spark, monkeypatch):
    """Where no vector of the audit has a link, those that the search linked are audited; without any link there is no recall."""
    monkeypatch.setattr(E, "SHARD", 40)
    monkeypatch.setattr(E, "AUDITED", 1)
    monkeypatch.setattr(E, "ASKED", 1)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 32))
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    schema = "vec_id long, embedding array<double>"
    assert {(r.n_links, r.recall) for r in E.near_duplicates(spark.createDataFrame(rows, schema)).collect()} == {(0, None)}
    linked = [*rows, (300, (v[7] + 0.01 * v[8]).tolist()), (301, (v[9] + 0.01 * v[8]).tolist())]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(linked, schema)).collect()}
    assert {k for k, r in got.items() if r.n_links} == {7, 9, 300, 301} and got[0].recall == 1.0
    monkeypatch.setattr(E, "recall", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.500"):
        E.near_duplicates(spark.createDataFrame(linked, schema))


def test_embeddings_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.op8_embedding_graph(spark, sf).collect()}
    assert got == embeddings_by_force(rows)


def decontaminated_by_force(docs, items):
    words = lambda t: D.words_of((t or "").encode())
    windows = {i: {tuple(w[k : k + min(13, len(w))]) for k in range(max(1, len(w) - 12))} for i, w in ((i, words(t)) for i, t in items) if w}
    out = []
    for _, t in docs:
        w, hit, found = words(t), set(), set()
        for item, ws in windows.items():
            n = len(next(iter(ws)))
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in ws:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("sieve", [1 << 20, 0])
def test_decontamination_edges(spark, monkeypatch, sieve):
    monkeypatch.setattr(D, "SIEVE", sieve)
    rng = np.random.default_rng(6)
    pick = lambda n: " ".join(rng.choice(list("abcdefghijk"), n))
    items = [(1, pick(40)), (2, pick(13)), (3, "Yes, No!"), (4, "q"), (5, None), (6, "!?"), (7, pick(12)), (7, pick(12)), (10, "a b c " * 30)]
    text = dict(items[:3])
    docs = [(1, None), (2, ""), (3, pick(60)), (4, pick(5) + " " + text[1] + " " + pick(400)), (5, text[2].upper()), (None, "yes...no"), (None, "Q q"), (8, "a b c " * 500), (9, "é " * 20 + text[1][:40]), (9, "é " * 20 + text[1][:40])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.n_words, r.n_hit, list(r.items), r.contaminated) for r in D.decontaminate(df, bench).collect()]
    assert sorted(got) == sorted(decontaminated_by_force(docs, items))
    assert {r.n_hit for r in D.decontaminate(df, bench.where("false")).collect()} == {0}
    assert D.decontaminate(df.where("false"), bench).count() == 0


def test_decontamination_counts_items_without_id(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(20))
    docs = [(1, "x y " + long), (2, "short one here"), (3, "clean"), (4, long)]
    bench = [(None, long), (None, "short one"), (None, None), (7, "short one here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r.items), r.contaminated) for r in D.decontaminate(df, items).collect())
    assert got == [(1, 22, 20, 1, [], True), (2, 3, 3, 2, ["7"], True), (3, 1, 0, 0, [], False), (4, 20, 20, 1, [], True)]
    monkeypatch.setattr(D, "table", lambda spark, sf_dir, name: {"documents": df, "benchmark": items}[name])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame({"item_id": pd.array([i for i, _ in bench], "Int64"), "text": [t for _, t in bench]}))
    assert sorted(tuple(r) for r in D.op10_decontamination(spark, "").collect()) == sorted(con.sql(D.OP10_SQL).fetchall())


def test_decontamination_keeps_columns_and_common_grams(spark):
    """A k-gram that all documents and items share, and input columns with names like those used inside."""
    rng = np.random.default_rng(9)
    pick = lambda n: " ".join(rng.choice(list("pqrstuvw"), n))
    items = [(k, "a a a a a a a " + pick(12)) for k in range(30)]
    docs = [(k, "a a a a a a a " + pick(k) + " " + items[k % 30][1] * (k % 3 == 0)) for k in range(60)]
    df = spark.createDataFrame([(i, t, "own", 1, 2, 3) for i, t in docs], "doc_id long, text string, key string, h int, hits int, _key int")
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == [*df.columns, "n_words", "n_hit", "n_items", "items", "contaminated"]
    rows = got.collect()
    assert {r.key for r in rows} == {"own"}
    assert sorted((r.n_words, r.n_hit, list(r.items), r.contaminated) for r in rows) == sorted(decontaminated_by_force(docs, items))


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (600, 2))] + [(k, k + 1) for k in range(2000, 2400)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
