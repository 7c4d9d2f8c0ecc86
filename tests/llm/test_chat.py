"""Reply trees: paths by brute force, escapes, masks and edges."""

import random

import pytest
from pyspark.sql import functions as F

from schemasight.llm import chat as C

HOSTILE = ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[\\/INST]", "[\\\\\\INST]", "<s>[INST]</s>[/INST]", "<<s>", "<\\s>\\", "[[INST]", "a\\nb", "%0A%25", "", "\n", "<s", "INST]"]


def read(rows):
    df = rows.withColumn("turns", C.turns_of(F.col("formatted"))).withColumn("learnt", C.learnt_texts(F.col("turns"), F.col("loss")))
    return df.collect()


def test_hostile_texts_come_back(spark):
    rows = [(k, j, role, text) for k, text in enumerate(HOSTILE) for j, role in enumerate(["user", "assistant", text, "assistant"])]
    trees = C.linear_trees(spark.createDataFrame(rows, "c long, t long, r string, x string").repartition(4), "c", "t", "r", "x")
    got = read(C.format_branches(trees, "tree", "node", "parent"))
    assert len(got) == len(HOSTILE)
    for r in got:
        text = HOSTILE[r.tree]
        assert [(t.role, t.text) for t in r.turns] == [("user", text), ("assistant", text), (text, text), ("assistant", text)]
        assert r.learnt == [text, text] and [s.turn for s in r.loss] == [1, 3]
        assert [r.formatted[s.start : s.end] for s in r.loss] == [r.turns[1].escaped] * 2
        assert sum(r.formatted.count(x) for x in C.LEARNT + C.GIVEN) == 8


def forest(seed, n):
    """Replies (tree, node, parent, role, text, score) to earlier ones."""
    r = random.Random(seed)
    return [(k % 3, k, r.choice([None, *range(k % 3, k, 3)][-8:]), r.choice(["user", "assistant", "tool"]), f"<s>é\U0001f600{k}" * r.randint(0, 3), r.choice([None, -1.0, 0.5, 2.0])) for k in range(n)]


@pytest.mark.parametrize("branches", [None, 2])
@pytest.mark.parametrize("block", [2, 256])
def test_paths(spark, branches, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = forest(1, 90)
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(4)
    got = read(C.format_branches(df, "tree", "node", "parent", score_col="score", branches=branches))
    by, answered = {r[1]: r for r in rows}, {r[2] for r in rows}
    want = {}
    for tree in range(3):
        found = []
        for leaf in (k for k in by if by[k][0] == tree and k not in answered):
            path, at = [], leaf
            while at is not None:
                path, at = [at, *path], by[at][2]
            found.append((-sum(by[k][5] or 0 for k in path), leaf, path))
        for rank, (score, leaf, path) in enumerate(sorted(found)[:branches], 1):
            want[tree, leaf] = (rank, -score, [(by[k][3], by[k][4]) for k in path])
    assert {(r.tree, r.leaf): (r.branch, r.score, [(t.role, t.text) for t in r.turns]) for r in got} == want
    for r in got:
        assert [t.text for t in r.turns if t.role == "assistant"] == r.learnt and r.n_turns == len(r.turns)
        assert [r.formatted[s.start : s.end] for s in r.loss] == [t.escaped for t in r.turns if t.role == "assistant"]


def test_edges(spark):
    rows = [
        (None, 1, None, "user", "a"), (None, 2, 1, None, None), (1, 1, 1, "user", "own parent"), (1, 5, 77, "user", "orphan"),
        (2, None, None, "user", "no id"), (2, None, None, "user", "no id"), (3, 1, None, "user", "b"), (3, 1, None, "user", "b"), (3, 2, 1, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "tree long, node long, parent long, role string, text string, uid string, up int")
    got = sorted((str((r.tree, r.leaf, r.branch, [(t.role, t.text) for t in r.turns], r.learnt)) for r in read(C.format_branches(df, "tree", "node", "parent"))))
    assert got == sorted(map(str, [
        (None, 2, 1, [("user", "a"), ("", "")], []), (1, 1, 1, [("user", "own parent")], []), (1, 5, 2, [("user", "orphan")], []),
        (2, None, 1, [("user", "no id")], []), (2, None, 2, [("user", "no id")], []), (3, 1, 1, [("user", "b")], []), (3, 2, 2, [("user", "b"), ("assistant", "")], [""]),
    ]))
    assert C.format_branches(df.where("false"), "tree", "node", "parent").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        C.format_branches(spark.createDataFrame([(1, 1, 2, "user", ""), (1, 2, 1, "user", "")], "tree long, node long, parent long, role string, text string"), "tree", "node", "parent")


def test_turns_are_ordered(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "first"), (1, 2, "assistant", "b"), (1, 9, "user", "last"), (None, 0, "user", None), (1, 9, "user", "last")]
    trees = C.linear_trees(spark.createDataFrame([(*r, "x") for r in rows], "c long, t long, r string, x string, node string").repartition(3), "c", "t", "r", "x")
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in read(C.format_branches(trees, "tree", "node", "parent"))}
    assert got == {1: [("user", "first"), ("assistant", "b"), ("user", "c"), ("user", "last"), ("user", "last")], None: [("user", "")]}


def test_a_long_branch_and_a_wide_tree(spark):
    chain = spark.range(3000).selectExpr("1L as tree", "id as node", "id - 1 as parent", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    star = spark.range(12_000).selectExpr("2L as tree", "id as node", "if(id = 0, null, 0L) as parent", "'user' as role", "concat('t', id) as text")
    got = C.format_branches(chain.unionByName(star), "tree", "node", "parent").withColumn("turns", C.turns_of(F.col("formatted"))).select("tree", "branch", F.col("turns.text").alias("t")).collect()
    long = [r.t for r in got if r.tree == 1]
    assert long == [[f"t{k}" for k in range(3000)]]
    wide = sorted((r.branch, r.t) for r in got if r.tree == 2)
    assert wide == [(k, ["t0", f"t{k}"]) for k in range(1, 12_000)]
