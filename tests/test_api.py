"""The calls of a user, on a small project."""

import json

import pytest

from schemasight import api, cli
from tests.test_files import project  # noqa: F401


def test_index_lines(spark, project):  # noqa: F811
    rows = api.index_lines(spark, project).collect()
    found = {(r.file_id, r.type) for r in rows}
    assert ("app/User.java", "MongoDB @Indexed") in found and ("db/V1__a.sql", "SQL CREATE INDEX") in found
    assert not any("build" in f for f, _ in found)
    total = {(r.project, r.type): r.n for r in api.projects(spark, [project, project]).collect()}
    assert total[None, None] == total[project, None] == 2 * len(rows)


def test_search_and_export(spark, project):  # noqa: F811
    assert {r.what for r in api.search(spark, project, "MADE").collect()} == {"suggestion"}
    lines = [r.line for r in api.export(spark, project).collect()]
    assert 'db.users.createIndex({ "a": 1, "b": -1 }, { unique: true });' in lines
    assert any("DESC" in r.line for r in api.export(spark, project, "postgresql").collect())
    with pytest.raises(ValueError):
        api.export(spark, project, "xml")


def test_compare(spark, project):  # noqa: F811
    script = spark.createDataFrame([('db.users.createIndex({ "b": -1, "a": 1 });',), ("db.users.createIndex({ zip: 1 });",)], "line string")
    status = {r.key: r.status for r in api.compare_script(spark, project, script).collect()}
    assert status["a:1,b:-1"] == "both" and status["zip:1"] == "script_only" and status["email:1"] == "code_only"
    live = spark.createDataFrame([("users", ["age", "x"])], "collection string, cols array<string>")
    assert {r.status for r in api.compare_live(spark, project, live).where("array_join(cols, ',') = 'age'").collect()} == {"exists"}


def test_families_and_team(spark, project, tmp_path):  # noqa: F811
    assert {r.category for r in api.check(spark, project, "application")["violations"].collect()} == {"Application Code"}
    catalog = tmp_path / "catalog.csv"
    catalog.write_text(f"Namespace,Team,ServiceName,Team Size,Team Members,Language,URI location if present,Sub Team,DB Service\nn,A,s1,1,x,java,{project}/app,,PostgreSQL\nn,A,s2,1,x,java,service not found,,PostgreSQL\nn,B,s3,1,x,java,{project},,none\n")
    got = {r.service: r.passed for r in api.check_team(spark, str(catalog), "a")["gate"].collect()}
    assert got == {"s1": False, None: False}
    assert api.check_team(spark, str(catalog), "b") == {}


def test_scripts_and_older_analysis(spark, project, tmp_path):  # noqa: F811
    (tmp_path / "tool.py").write_text('db = client["x"]\ncoll = db["carts"]\ncoll.find_one({"name": 1, "$or": 2})\n')
    found = {(r.field, r.collection, r.operation) for r in api.script_usages(spark, project).collect()}
    assert ("name", "carts", "find") in found and any(f == "status" for f, _, _ in found)
    assert api.older_suggestions(spark, project, 2).count() == 2
    (tmp_path / "application.yml").write_text("mongodb.database: shop\n")
    assert [r.name for r in api.databases(spark, project).collect()] == ["shop"]
    assert [r.name for r in api.databases(spark, project, deployed=True).collect()] == ["shop"]
    assert {r.database for r in api.indexes(spark, project).collect()} == {"shop"}
    text = [r.line for r in api.script(spark, project).collect()]
    assert text[:3] == ["// Auto-generated MongoDB index creation script", "// Generated from source code analysis", ""]
    assert text[3:6] == ["// Database: shop", "use shop;", ""]
    assert 'db.users.createIndex({"email": 1}, {"unique": true, "expireAfterSeconds": 3600});' in text
    assert 'db.users.createIndex({"words": "text"});' in text
    python = [r.line for r in api.script(spark, project, "pymongo").collect()]
    assert "from pymongo import MongoClient, ASCENDING, DESCENDING, TEXT" in python


def test_report(spark, project, tmp_path):  # noqa: F811
    (tmp_path / "app" / "bad.java").write_bytes(b"\xff")
    api.check_report(spark, project, str(tmp_path / "report"))
    rows = spark.read.text(str(tmp_path / "report"))
    parts = {r.section: json.loads(r.value) for r in rows.collect()}
    assert set(parts) == {"gate_decision", "summary", "violations", "errors"}
    assert parts["gate_decision"]["passed"] is False and parts["summary"]["migration_files_scanned"] == 3


def test_command_line(spark, project, capsys):  # noqa: F811
    assert cli.main(["check", project]) == 1
    assert cli.main(["export", project]) == 0
    assert cli.main(["scan", project]) == 0
    assert "createIndex" in capsys.readouterr().out
