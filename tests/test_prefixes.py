"""Pairs of indexes whose columns begin each other: every pair once, none of them shuffled."""

import random

import pytest

from schemasight.operators import indexes as I
from schemasight.queries import QUERIES

SCHEMA = "table_name string, index_name string, cols array<string>"


def begin_each_other(rows):
    return {(t, a, b) for t, a, c in rows for u, b, d in rows if t == u and t is not None and c and d and len(c) < len(d) and d[: len(c)] == c}


def shuffled(spark, run):
    """What ``run`` gives, and the rows that its stages shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    out = run()
    return out, sum(n for k, n in stages().items() if k > before)


@pytest.mark.parametrize("block", [1, 3, I.BLOCK])
def test_every_pair_once(spark, block):
    """Indexes with several lists, lists that begin each other, equal lists, and nulls, in blocks of any size."""
    pick = random.Random(1)
    lists = [None, []] + [[pick.choice("ab") for _ in range(pick.randint(1, 4))] for _ in range(12)]
    rows = [(pick.choice(["t", "u", None]), pick.choice([None] + [f"i{n}" for n in range(40)]), pick.choice(lists)) for _ in range(200)]
    got = [tuple(r) for r in I.prefixes(spark.createDataFrame(rows, SCHEMA), block).collect()]
    assert len(got) == len(set(got)) and set(got) == begin_each_other(rows)


def test_pairs_are_not_shuffled(spark):
    rows = [("t", f"a{n}", ["x"]) for n in range(300)] + [("t", f"b{n}", ["x", "y"]) for n in range(300)]
    defs = spark.createDataFrame(rows, SCHEMA)
    for block in (100, I.BLOCK):
        pairs, moved = shuffled(spark, lambda n=block: I.prefixes(defs, n).count())
        assert pairs == 90_000
        assert moved < 10_000


def test_pairs_query_does_not_shuffle_pairs(spark, tmp_path):
    lines = [(50 * n, line, line) for n in range(600) for line in range(1 + n % 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found, moved = shuffled(spark, lambda: QUERIES["idx_prefix_pairs"](spark, str(tmp_path)).collect())
    assert {tuple(r) for r in found} == {("t0", f"ix_{50 * a}", f"ix_{50 * b}") for a in range(0, 600, 2) for b in range(1, 600, 2)}
    assert len(found) == 90_000
    assert moved < 20_000


def test_names_are_not_broadcast(spark, sf):
    assert "BroadcastExchange" not in QUERIES["idx_prefix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
