"""Annotated classes: one pass, whatever the text; constants and errors."""

import time

import pytest

from schemasight.operators import lines as L
from schemasight.queries import QUERIES
from schemasight.sources import annotations as A


@pytest.mark.parametrize("filler", [" " * 500, "a" * 500, "a " * 250, "\n" * 500, "(" * 500, "@Indexed " * 60, "'" * 500, '"' * 499, "/*" * 250, "<,>" * 160, "\\" * 500, "x = " * 125, "@CompoundIndex(" * 40])
def test_any_text_is_read_in_time_that_grows_with_it(filler):
    def took(times):
        source = f'@Document\nclass A {{\n@Indexed{filler * times}\n@CompoundIndex(def = "{{{filler * times}'
        began = time.perf_counter()
        A.declared_in(source)
        return time.perf_counter() - began

    took(1)
    assert min(took(1) for _ in range(5)) < 0.02
    assert min(took(80) for _ in range(2)) < 1.5


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("private String a;", "a"), (" int b = 1;", "b"), (" Map<String, List<X>> c ;", "c"), ("\n@NotNull\nprotected Long d;", "d"), (";", None), ("x;", None), ("return f(x); int e;", "e"), (" a.b = 1; Y g;", "g"),
        ("  h;", "h"), (" é_1 ñ;", "ñ"), (" " * 499 + "x y;", None), (" " * 495 + "x y;", "y"), ("", None), ("String[] s; int t;", "t"),
    ],
)
def test_field_behind(text, name):
    assert A.field_behind(text, 0) == name


def test_brackets_strings_and_comments():
    source = """
@CompoundIndexes(value = { @CompoundIndex(name = "a)(", def = "{'x': 1, \\"y\\": -1, 'z': 1}", unique = TRUE) }) // ) :(
/* @CompoundIndex(def = "{'c': 1}") ( */
@CompoundIndex(def = "{'d': 1}", sparse=true)
// @Indexed(
class A { @Indexed(name = ")", expireAfterSeconds = 5) private String s; char c = '('; @TextIndexed String t; }"""
    found = A.annotations_in(source)
    assert [(a.name, a.inside) for a in found] == [("CompoundIndexes", False), ("CompoundIndex", True), ("CompoundIndex", False), ("CompoundIndex", False), ("Indexed", False), ("Indexed", False), ("TextIndexed", False)]
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[7]) for r in A.declared_in(source)]
    assert rows == [
        ("compound", "x:1,z:1", "a)(", True, False, None, None), ("compound", "c:1", None, False, False, None, None), ("compound", "d:1", None, False, True, None, None),
        (None, None, None, False, False, None, "@Indexed: its brackets do not close"), ("single", "s:1", None, False, False, 5, None), ("text", "t:text", None, False, False, None, None),
    ]


def test_constants_and_errors(spark):
    source = """@Document class Order {
@CompoundIndex(def = "{'A.F': 1, 'F': 1, 'G': -1, 'own': 1}")
@CompoundIndex(def = "{'F': 3}")
@Indexed String G;"""
    df = spark.createDataFrame([("p/Order.java", source), ("empty", ""), ("none", None), ("q", "class X { @Indexed int a; }")], "path string, content string")
    constants = L.constants_map(spark.createDataFrame([("A", "F", "name", 1), ("A", "G", "name", 2), ("A", "own_", "x", 3)], "class string, field string, value string, seq int"))
    found = A.with_constants(A.declared(df), constants)
    assert sorted((r.collection, r.kind, r.fields) for r in found.collect()) == [("order", "compound", "name:-1,own:1"), ("order", "single", "name:1")]
    assert found.columns == A.declared(df).columns
    assert [tuple(r) for r in A.misdeclared(df).collect()] == [("p/Order.java", "p/Order.java:3: @CompoundIndex: direction 3 of field F")]
    assert A.with_constants(A.declared(df.where("false")), constants).count() == 0


def test_constants_row_by_row(spark):
    """Rows that are alike stay as many as they are; two files of one path don't mix; lists without a constant stay as they are."""
    constants = spark.createDataFrame([("F", "x"), ("G", "x"), ("N", None)], "name string, value string")
    given = [("a:1,F:1,b:-1,G:-1", 0), ("a:1,F:1,b:-1,G:-1", 0), ("F:1", 0), ("c:1,c:-1", 1), ("c:1,c:-1,N:1", 2), (None, 3), ("", 4), ("p:text", 5), ("x:1,F:text", 6)]
    df = spark.createDataFrame([("name", f, ("path", n)) for f, n in given], "name string, fields string, seq struct<path: string, pos: int>")
    found = A.with_constants(df, constants)
    assert found.columns == df.columns
    got = sorted((r.seq.pos, "null" if r.fields is None else r.fields) for r in found.collect())
    assert got == [(0, "a:1,x:-1,b:-1"), (0, "a:1,x:-1,b:-1"), (0, "x:1"), (1, "c:1,c:-1"), (2, "c:-1,N:1"), (3, "null"), (4, ""), (5, "p:text"), (6, "x:text")]


def test_constants_are_looked_up_without_sending_indexes_to_the_driver(spark, sf):
    """Of the two sides only constants may be broadcast, and classes are read once."""
    for most in ("10m", "1g"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            plan = QUERIES["resolved_compounds"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert plan.count("+- BroadcastExchange") == 1
        assert plan.count("ArrowEvalPython [") == 1
