"""Constraints of table bodies."""

import time

import pytest

from schemasight.functions import tablesql as K
from schemasight.plans import scan
from schemasight.sources import files


def read(sql):
    return [x[:-1] if not x[-1] else (*x[:-1], "inline") for x in K.constraints_in(sql)]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("CREATE TABLE t (a INT, CONSTRAINT p PRIMARY KEY (a, b))", [(1, "p", "PRIMARY KEY", ["a", "b"], None, [], None)]),
        ("create unlogged table if not exists \"S\".\"T\" (a int primary key)", [(0, None, "PRIMARY KEY", ["a"], None, [], None, "inline")]),
        ("CREATE TABLE t (foreign key (a, \"b,\"\"c\") references x.y (k, l) on delete set null, b int)", [(0, None, "FOREIGN KEY", ["a", 'b,"c'], "y", ["k", "l"], None)]),
        ("CREATE TABLE t (FOREIGN KEY (a) REFERENCES y)", [(0, None, "FOREIGN KEY", ["a"], "y", [], None)]),
        ("CREATE TABLE t (a text CHECK (a <> ')' AND f(a, ',')) NOT NULL, UNIQUE (a, lower(b) DESC))", [(0, None, "CHECK", ["a"], None, [], "a <> ')' AND f(a, ',')", "inline"), (1, None, "UNIQUE", ["a", "lower"], None, [], None)]),
        ("CREATE TABLE t (a int DEFAULT nextval('x, (') UNIQUE, \"check\" int, check_x int)", [(0, None, "UNIQUE", ["a"], None, [], None, "inline")]),
        ("CREATE TABLE t /* ( */ (a int -- CHECK (\n, CHECK (a > 1)", [(1, None, "CHECK", [], None, [], "a > 1")]),
        ("CREATE TABLE t (a int, CHECK (a > 1", [(1, None, "CHECK", [], None, [], "a > 1")]),
        ("CREATE TABLE t (EXCLUDE USING gist (c WITH &&), a int)", [(0, None, "EXCLUDE", [], None, [], "c WITH &&")]),
        ("CREATE TABLE t AS SELECT 1", []), ("CREATE INDEX i ON t (a)", []), ("", []), ("CREATE TABLE t (", []), ("SELECT 'CREATE TABLE t (a int primary key)'", []),
    ],
)
def test_constraints(sql, want):
    assert read(sql) == want


@pytest.mark.parametrize("filler", ["(", "'", '"', " ", "a", "a.", "CHECK (", ",", "/*", "--", "''", "CONSTRAINT "])
def test_any_text_is_read_in_time_that_grows_with_it(filler):
    began = time.perf_counter()
    try:
        K.constraints_in("CREATE TABLE t (" + filler * 20_000)
    except RecursionError:
        pytest.fail("nested too deep")
    assert time.perf_counter() - began < 3


def test_unique_constraints_are_indexes(spark, tmp_path):
    (tmp_path / "V1__a.sql").write_text("CREATE TABLE t (a INT, b INT, CONSTRAINT u UNIQUE (a, b), UNIQUE (b), FOREIGN KEY (a) REFERENCES o (id), PRIMARY KEY (a));\nCREATE INDEX i ON t (a, b);\nCREATE INDEX j ON t (b);")
    found = scan.schema_of(files.statements(files.migrations(spark, str(tmp_path))))
    assert [(r.index_name, r.cols) for r in found["indexes"].orderBy("seq").collect()] == [("u", ["a", "b"]), ("t_b_key", ["b"]), ("i", ["a", "b"]), ("j", ["b"])]
    assert [(r.fk_cols, r.dst) for r in found["foreign"].collect()] == [(["a"], "o")]
    assert {(r.name, r.is_pk) for r in found["columns"].collect()} == {("a", True), ("b", False)}
    hits = {(r.rule_id, r.line_no) for r in scan.check(spark, str(tmp_path))["violations"].collect()}
    assert {("IDX002", 2), ("IDX002", 3)} <= hits
