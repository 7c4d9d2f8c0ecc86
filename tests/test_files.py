"""Sources, whole pipelines, sinks and streams on small directories."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from schemasight import sinks
from schemasight.functions import sqltext as S
from schemasight.functions import text as T
from schemasight.operators import discovery, references
from schemasight.operators import lines as lines_of
from schemasight.operators import rules as R
from schemasight.plans import scan
from schemasight.sources import annotations, configuration, files
from schemasight.streaming import watch

ENTITY = """package x;
@Document(collection = "users")
@CompoundIndexes({
  @CompoundIndex(name = "a_b", def = "{'a': 1, 'b': -1}", unique = true),
  @CompoundIndex(def = "{'status': 1}")
})
public class User {
  @Indexed(unique = true, expireAfterSeconds = 3600)
  private String email;
  @TextIndexed
  private List<String> words;
  @Indexed private String tenant;
}
"""
DAO = """class Dao {
  void a() {
    coll = db.getCollection("users");
    coll.find(Filters.eq("status", s));
    coll.find(Filters.gt("age", 5));
    coll.find(new BasicDBObject(AppConstants.KEY, 1)).sort(Sorts.ascending("made"));
    Statement st = c.createStatement();
    st.executeQuery("SELECT * FROM t WHERE a = " + a);
  }
}
"""
SQL = """-- first; not a statement
CREATE TABLE orders (id INT PRIMARY KEY, status TEXT, customers_id INT, total NUMERIC, note VARCHAR(9000), made TIMESTAMP WITHOUT TIME ZONE NOT NULL,
  CONSTRAINT fk FOREIGN KEY (customers_id) REFERENCES customers(id));
CREATE TABLE customers (a INT NOT NULL DEFAULT (1), b JSON, orders_id BIGINT);
CREATE INDEX ix_a ON orders (a, b); CREATE INDEX ix_b ON orders (a);
DROP TABLE old; SELECT ';' FROM t /* ; */ WHERE a = 'it''s;'
"""


@pytest.fixture
def project(tmp_path):
    for name, text in {"app/User.java": ENTITY, "app/Dao.java": DAO, "app/AppConstants.java": 'class AppConstants { public static final String KEY = "key"; }', "app/test/UserTest.java": ENTITY, "app/build/Gen.java": ENTITY, "db/V1__a.sql": SQL, "db/V2__b.sql": "TRUNCATE t", "db/undo_V2__b.sql": "SELECT 1"}.items():
        path = Path(tmp_path, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_java_sources_leave_out_tests_and_builds(spark, project):
    assert {r.path for r in files.java_sources(spark, project).collect()} == {"app/User.java", "app/Dao.java", "app/AppConstants.java"}
    assert {r.project for r in files.projects(files.files(spark, project)).collect()} == {"app", "db"}


def test_declared_indexes(spark, project):
    found = {(r.kind, r.fields): r for r in annotations.declared(files.java_sources(spark, project)).collect()}
    assert set(found) == {("compound", "a:1,b:-1"), ("compound", "status:1"), ("single", "email:1"), ("text", "words:text"), ("single", "tenant:1")}
    assert found["compound", "a:1,b:-1"].unique and found["single", "email:1"].ttl == 3600
    assert {r.collection for r in found.values()} == {"users"}


def test_suggestions_of_a_project(spark, project):
    found = scan.scan_indexes(spark, project)
    got = {(r.collection, r.fields, r.priority) for r in found["suggestions"].collect()}
    assert ("users", "made", "high") in got and ("users", "age", "medium") in got
    assert any(r.fields.startswith("status,key") or r.fields == "status,age" for r in found["suggestions"].where("kind = 'compound'").collect())
    assert not any(f == "status" for _, f, _ in got)


def test_gate_of_a_project(spark, project):
    out = scan.check(spark, project)
    ids = {(r.rule_id, r.file_id) for r in out["violations"].collect()}
    sql = "db/V1__a.sql"
    for rule in ("PG-MIG-001", "PG-MIG-005", "PG-MIG-006", "PG-MIG-007", "IDX001", "IDX003", "schema.no_primary_key", "schema.numeric_without_precision", "schema.varchar_exceeds_max_length", "schema.timestamp_without_timezone", "schema.json_instead_of_jsonb", "schema.not_null_without_default", "schema.nullable_business_column", "schema.missing_foreign_key"):
        assert (rule, sql) in ids, rule
    assert ("PG-MIG-005", "db/V2__b.sql") not in ids and ("PG-MIG-005", "db/undo_V2__b.sql") in ids
    assert {r for r, f in ids if f == "app/Dao.java"} == {"APP001", "APP002", "APP003", "APP004"}
    gate = out["gate"].first()
    assert not gate.passed and gate.total == out["violations"].count()
    page = sinks.html_report(out["violations"], out["gate"])
    assert "Blocked" in page and page.index("Migration Safety") < page.index("Index Design")


def test_overrides_and_disabled_rules(spark, project):
    config = configuration.Config(severity_overrides={"PG-MIG-001": "High"}, disabled_rules=["PG-MIG-006"])
    rows = {r.rule_id: r for r in scan.check(spark, project, config)["violations"].collect()}
    assert rows["PG-MIG-001"].action == "Warn" and "PG-MIG-006" not in rows
    with pytest.raises(ValueError):
        configuration.Config(severity_overrides={"x": "Huge"})


def test_splitter():
    assert [(n, line) for n, line, _ in S.split_statements(SQL)] == [(1, 2), (2, 4), (3, 5), (4, 5), (5, 6), (6, 6)]
    assert S.split_statements("") == S.split_statements(None) == S.split_statements(" ; -- x") == []
    assert S.table_body("CREATE TABLE t (a NUMERIC(1, 2) DEFAULT (f(',')), b INT)") == ["a NUMERIC(1, 2) DEFAULT (f(','))", "b INT"]


def test_catalog_and_settings(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text('namespace , Team,ServiceName,Team Size,Team Members,Language,URI location if present,Sub Team,DB Service\nn, A ,s,1,x,java,git/x,,"MongoDB, PostgreSQL"\n,,,,,,,,\n')
    assert [(r.team, r.db_service) for r in configuration.catalog(spark, str(path)).collect()] == [("A", "MongoDB, PostgreSQL")]
    path.write_text("Team\nA\n")
    with pytest.raises(ValueError):
        configuration.catalog(spark, str(path))
    assert dict(configuration.flattened({"env": [{"name": "DB", "value": "v"}], "a": {"B": 1}})) == {"env.db": "v", "db": "v", "a.b": "1", "b": "1"}
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc" / "values.yaml").write_text("spring:\n  url: jdbc:postgresql://h/db1\n")
    got = configuration.settings(files.files(spark, str(tmp_path), "*.yaml")).collect()
    assert ("svc", "url", "jdbc:postgresql://h/db1") in {(r.service, r.key, r.value) for r in got}


def test_databases_of_settings_environments_code_and_constants(spark, tmp_path):
    (tmp_path / "application.properties").write_text("#mongodb.database=no\nmongodb.database=shopDb\nspring.data.mongodb.uri=mongodb://h/orders?x\nmongodb.database=test\nmongodb.database=${X}\n")
    (tmp_path / "other.properties").write_text("mongodb.database=nowhere\n")
    (tmp_path / ".env").write_text("APP_MONGO_DB='carts'\n")
    (tmp_path / "A.java").write_text('x.getDatabase("stock");')
    constants = spark.createDataFrame([("C.DB_NAME", "late"), ("DB_NAME_TABLE", "never")], "name string, value string")
    got = discovery.database_names(files.files(spark, str(tmp_path)), constants).orderBy("seq").collect()
    assert [r.name for r in got] == ["carts", "stock", "shopDb", "orders", "late"]
    filled = discovery.with_primary_database(spark.createDataFrame([("a", None), ("b", "own")], "x string, database string"), discovery.database_names(files.files(spark, str(tmp_path))))
    assert {(r.x, r.database) for r in filled.collect()} == {("a", "carts"), ("b", "own")}


def test_hidden_and_unreadable_files(spark, tmp_path):
    for name, data in {"_x.sql": b"SELECT 1", ".git/y.sql": b"no", ".mvn/z.sql": b"SELECT 2", "a.sql": b"SELECT 3", "bad.sql": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.content for r in files.files(spark, str(tmp_path), "*.sql", strict=True).collect()}
    assert got == {"_x.sql": "SELECT 1", ".mvn/z.sql": "SELECT 2", "a.sql": "SELECT 3", "bad.sql": ""}
    assert [r.error.endswith("bad.sql: not valid UTF-8") for r in files.unreadable(spark, str(tmp_path)).collect()] == [True]


def test_collections_over_several_lines(spark):
    text = 'x();\nmongoTemplate.find(\n  query,\n  User.class );\na();\ntemplate.drop("test"); template.findAll("carts");\nb();'
    code = spark.createDataFrame([("f", text)], "file_id string, content string")
    none = spark.createDataFrame([], "name string, value string")
    lines = lines_of.with_offset(files.lines(code, "file_id"))
    got = references.collection_at(lines, references.named(references.references(code), none)).orderBy("line_no").collect()
    assert [r.collection for r in got] == ["unknown", "user", "user", "user", "user", "user", "carts"]


def test_fields_behind_annotations(spark):
    text = "@Indexed\n@NotNull\nprivate String a;\n@Indexed(unique = true) // " + "x" * 600 + "\nprivate String b;\n@Indexed int c;"
    df = spark.createDataFrame([("p", text)], "path string, content string")
    assert [r.field for r in annotations.next_fields(df).orderBy("nth").collect()] == ["a", None, "c"]


def test_config_file(tmp_path):
    path = tmp_path / "rules.yaml"
    assert configuration.load_config(str(path)) == configuration.Config()
    path.write_text("disabled_rules: [IDX002]\nrollback_directory: undo\nthresholds: {offset_limit: 5, composite_pk_max_columns: 2}\naurora_connection: {host: h}\n")
    assert configuration.load_config(str(path)) == configuration.Config(disabled_rules=["IDX002"], rollback_directory="undo", max_offset=5, max_pk_columns=2)
    for wrong in ("thresholds: {offset_limit: -1}", "thresholds: {composite_pk_max_columns: 0}", "thresholds: 5", "severity_overrides: [a]", "severity_overrides: {A: Huge}", "disabled_rules: x", "database_type: oracle", "thresholds: {offset: 1}", "aurora_connection: {port: 1}", "aurora_connection: {host: h, ssl_mode: none}", "- a"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            configuration.load_config(str(path))


def test_empty_gate_passes(spark):
    none = spark.createDataFrame([], "severity string, action string")
    assert R.gate(none).first().asDict() == {"total": 0, "critical": 0, "high": 0, "medium": 0, "low": 0, "blocking": 0, "passed": True}


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("a b/c", 1, None), ("d", 2, "x")], "service string, n int, note string")
    sinks.write_json(df, str(tmp_path / "out"), "service")
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.json")}
    assert found == {"service=a_b_c": {"n": 1}, "service=d": {"n": 2, "note": "x"}}


def test_stream_finds_what_the_batch_finds(spark, project):
    q = watch.watched(watch.incoming(spark, project + "/app")).writeStream.format("memory").queryName("watched").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.file_id.rsplit("/", 1)[-1], r.line_no, r.rule_id) for r in spark.table("watched").collect()}
    want = {(r.file_id.rsplit("/", 1)[-1], r.line_no, r.rule_id) for r in R.code_rules(files.lines(files.files(spark, project + "/app", "*.java"))).collect()}
    assert got == want and want


@pytest.mark.parametrize(("name", "ok"), [("orders", True), ("a", False), ("ADMIN", False), ("admin", False), ("UserService", False), ("shopDb", True), ("someThing", False), ("$x", False), (None, False)])
def test_database_names(spark, name, ok):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(T.is_database_name(F.col("name"))).first()[0] is ok
