"""Readers of joins, sort items, script calls and joined texts: rows written by hand."""

import pytest
from pyspark.sql import functions as F

from schemasight.functions import sqltext as S
from schemasight.operators import rules as R
from schemasight.operators import scripts as P


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("sql, want", [
    ("SELECT 1 FROM a", []),
    ("SELECT 1 FROM a JOIN b ON a.id = b.a_id", ["id", "a_id"]),
    ("SELECT 1 FROM a JOIN b USING (id) JOIN c ON b.x = c.y WHERE a.z = 1", ["x", "y"]),
    ("SELECT 1 FROM a JOIN b ON a.k = b.l JOIN c ON b.m = c.n JOIN d ON c.o = d.p ORDER BY 1", ["k", "l", "o", "p"]),
    ("SELECT 1 FROM a JOIN b\nON s.a.k = 1.5\nGROUP BY a.g", ["k"]),
    ("SELECT 1 FROM a JOIN b ON a.k = b.k AND a.k = b.j", ["k", "j"]),
])
def test_join_columns(spark, sql, want):
    assert one(spark, S.join_columns, sql) == want


@pytest.mark.parametrize("sql, want", [
    ("SELECT 1", []),
    ("SELECT 1 ORDER BY a, t.b DESC NULLS LAST, s.t.c asc LIMIT 3", ["a", "b", "c"]),
    ("SELECT 1 ORDER BY 2, lower(d), e\nFETCH FIRST ROW ONLY", ["e"]),
    ("SELECT 1 order by f, f;", ["f"]),
])
def test_order_columns(spark, sql, want):
    assert one(spark, S.order_columns, sql) == want


@pytest.mark.parametrize("text, want", [
    ("""{a: 1, "b": -1, 'c': "text", "d.e": "2dsphere"}""", "a:1,b:-1,c:text,e:2dsphere"),
    ("{ }", ""), ("", ""), ("{a: 'text', b: 1}", "b:1"),
])
def test_shell_keys(spark, text, want):
    assert one(spark, P.shell_keys, text) == want


@pytest.mark.parametrize("text, want", [
    ("""[("a", ASCENDING), ('b', -1), ("c", TEXT), ("d",HASHED)]""", "a:1,b:-1,c:text,d:hashed"),
    ('[("a", UNKNOWN), ("b", 1)]', "b:1"), ("[]", ""),
])
def test_pymongo_keys(spark, text, want):
    assert one(spark, P.pymongo_keys, text) == want


def test_script_calls(spark):
    text = """db.a.createIndex ( {x: 1} ); db.b.dropIndexes(); y.createIndex({z: -1}, {unique: true}); coll.createIndex({q: 1});
db['c'].create_index([("k", 1)]); db["d"].create_index("k"); db.getCollection("e").createIndex({x: 1}); f.createIndex({})"""
    got = P.script_calls(spark.createDataFrame([(1, text), (2, ""), (3, None)], "file_id int, content string")).drop("file_id").collect()
    assert sorted(map(tuple, got)) == [
        (0, 0, "a", "x:1", "db.a.createIndex ( {x: 1}"), (1, 0, "c", "k:1", """db['c'].create_index([("k", 1)]"""),
        (2, 0, "a", "x:1", "a.createIndex ( {x: 1}"), (2, 1, "y", "z:-1", "y.createIndex({z: -1}"),
    ]


@pytest.mark.parametrize("line, want", [
    ('q = "SELECT a FROM t WHERE b = " + b;', True),
    ('q = name + " ORDER BY x"', True),
    ('q = name + "WHERE', True),
    ('q = "SELECT a" + "FROM t";', False),
    ('q = "hello " + name + "!";', False),
    ('log("a" + where + "b");', False),
    ("x + y", False), ("", False),
])
def test_joins_sql(spark, line, want):
    assert one(spark, R.joins_sql, line) is want
