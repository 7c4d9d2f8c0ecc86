"""Rules on live indexes, from the connection of a configuration; the server is a table here."""

from schemasight import api
from schemasight.sources import configuration


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("DB_SECRET", "s3cret")
    monkeypatch.delenv(configuration.PASSWORD_VARIABLE, raising=False)
    assert configuration.jdbc_options({"host": "h"}) == {"url": "jdbc:postgresql://h:5432/?sslmode=require"}
    full = {"host": "h", "port": 6000, "database": "shop", "username": "u", "password_env_var": "DB_SECRET", "ssl_mode": "verify-full"}
    assert configuration.jdbc_options(full) == {"url": "jdbc:postgresql://h:6000/shop?sslmode=verify-full", "user": "u", "password": "s3cret"}


def test_unused_indexes_of_a_server(spark, tmp_path, monkeypatch):
    live = spark.createDataFrame([("t", "never", 10, 0), ("t", "used", 99, 5), ("u", "never_big", 500, 0), ("u", "unsized", None, 0)], "table_name string, index_name string, size_bytes long, idx_scan long")
    asked = []
    monkeypatch.setattr(api, "postgres_usage", lambda s, url, **options: (asked.append(url), live)[1])
    path = tmp_path / "rules.yml"
    path.write_text("aurora_connection: {host: db, database: shop}\n")
    got = [(r.index_name, r.size_bytes, r.rule_id) for r in api.runtime_violations(spark, str(path)).collect()]
    assert got == [("never_big", 500, "PG_IDX_014"), ("never", 10, "PG_IDX_014"), ("unsized", 0, "PG_IDX_014")]
    assert asked == ["jdbc:postgresql://db:5432/shop?sslmode=require"]
    path.write_text("aurora_connection: {host: db}\ndisabled_rules: [PG_IDX_014]\n")
    assert api.runtime_violations(spark, str(path)).count() == 0
    path.write_text("disabled_rules: []\n")
    assert api.runtime_violations(spark, str(path)) is None
