"""Cycles of foreign keys by components, and prefix classes, against plain loops."""

import random
import time

import pytest

from schemasight.operators import indexes as I
from schemasight.operators import rules as R


def shortest(edges, source, target):
    """The shortest way from source to target, of equals that with the least names."""
    ways, seen = [[source]], {source}
    while ways:
        for w in sorted(ways):
            if w[-1] == target:
                return w
        longer = {}
        for w in ways:
            for a, b in edges:
                if a == w[-1] and b not in seen:
                    longer[b] = min(longer.get(b, [*w, b]), [*w, b])
        seen |= set(longer)
        ways = list(longer.values())
    return None


def brute(edges):
    ways = (shortest(edges, b, a) for a, b in edges)
    return {",".join(sorted(w)) for w in ways if w}


def found(spark, files):
    rows = [(f, a, b) for f, edges in files.items() for a, b in edges]
    out = R.foreign_key_cycles(spark.createDataFrame(rows, "file_id long, src string, dst string")).collect()
    assert len({tuple(r) for r in out}) == len(out)
    return {f: {r.tables for r in out if r.file_id == f} for f in files}


def test_random_schemas(spark):
    r = random.Random(3)
    files = {f: [(f"t{r.randrange(9)}", f"t{r.randrange(9)}") for _ in range(r.randint(1, 22))] for f in range(25)}
    files[100] = [(f"a{k}", f"a{(k + 1) % 14}") for k in range(14)] + [("a3", "a1"), ("a13", "x"), ("x", "y"), ("y", "x"), ("z", "z")]
    assert found(spark, files) == {f: brute(set(e)) for f, e in files.items()}


def test_a_complete_graph_ends(spark):
    names = [f"t{k:02}" for k in range(25)]
    began = time.perf_counter()
    out = found(spark, {1: [(a, b) for a in names for b in names if a != b]})
    assert out[1] == {f"{a},{b}" for a in names for b in names if a < b} and time.perf_counter() - began < 60


def test_no_cycle(spark):
    assert found(spark, {1: [("a", "b"), ("b", "c"), ("a", "c")]}) == {1: set()}
    assert R.foreign_key_cycles(spark.createDataFrame([], "file_id long, src string, dst string")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_prefix_classes(spark, seed):
    r = random.Random(seed)
    rows = [(f"t{r.randrange(3)}", f"i{k}", k, [r.choice("abc") for _ in range(r.randint(1, 4))]) for k in range(60)]
    df = spark.createDataFrame(rows, "table_name string, index_name string, seq long, cols array<string>")
    lists = {}
    for t, name, _, cols in rows:
        lists.setdefault((t, tuple(cols)), []).append(name)
    want = set()
    for (t, cols), names in lists.items():
        below = [x for (u, c), x in lists.items() if u == t and len(c) > len(cols) and c[: len(cols)] == cols]
        above = [c for u, c in lists if u == t and len(c) < len(cols) and cols[: len(c)] == c]
        parent = lists[t, max(above, key=len)][0] if above else None
        want.add((t, cols, names[0], len(names), parent, len(below), len(names) * sum(map(len, below))))
    got = I.prefix_classes(df).collect()
    assert {(x.table_name, tuple(x.cols), x.index_name, x.members, x.parent, x.longer, x.links) for x in got} == want and len(got) == len(want)
    assert sum(x.links for x in got) == I.prefixes(df).count()
