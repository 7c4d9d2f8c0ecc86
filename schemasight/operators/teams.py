"""Service catalogs, database connections and live catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemasight.functions.text import database_uri


def same_name(column: str, name: str) -> Column:
    return F.lower(F.btrim(column)) == name.strip().lower()


def of_team(catalog: DataFrame, team: str) -> DataFrame:
    return catalog.where(same_name("team", team))


def selected(catalog: DataFrame, team: str | None = None, namespace: str | None = None, sub_team: str | None = None) -> DataFrame:
    """Services of a team, a namespace, a sub-team, or several of these; case and blanks around do not count."""
    for column, name in (("team", team), ("namespace", namespace), ("sub_team", sub_team)):
        catalog = catalog if name is None else catalog.where(same_name(column, name))
    return catalog


def by_service(violations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Violations (project, ...) with the services (service_name) whose repository the project is."""
    services = catalog.select("service_name", F.col("uri_location").alias("project")).distinct()
    return violations.join(services, "project")


def with_kinds(catalog: DataFrame) -> DataFrame:
    """Add has_postgres, has_mongodb, has_path (a usable repository) and supported (some database is named)."""
    db = F.lower(F.coalesce("db_service", F.lit("")))
    path = F.lower(F.coalesce("uri_location", F.lit("")))
    return catalog.withColumns({
        "team": F.btrim("team"), "has_postgres": db.contains("postgresql"), "has_mongodb": db.contains("mongodb"),
        "has_path": (path != "") & ~path.contains("service not found"), "supported": ~F.btrim(db).isin("", "none"),
    })


def team_names(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.btrim("team").alias("team")).where("team <> ''").distinct().orderBy("team")


def rollup(catalog: DataFrame) -> DataFrame:
    """Services of each team that a scan would cover or skip."""
    scanned = F.col("has_path") & F.col("supported")
    return catalog.groupBy("team").agg(F.count("*").alias("services"), F.count_if(scanned).alias("scanned"), F.count_if(~scanned).alias("skipped"), F.count_if(scanned & F.col("has_postgres")).alias("postgres"))


def connections(env: DataFrame) -> DataFrame:
    """Database connections in settings (service, key, seq, value): one row for each value of a service, the first key that has it."""
    found = env.withColumns(database_uri(F.col("value"))).where("kind is not null")
    return found.groupBy("service", "value", "kind", "host", "port", "name").agg(F.min_by("key", "seq").alias("key"))


def unused(catalog: DataFrame) -> DataFrame:
    """Indexes without scans (PG_IDX_014), the largest first."""
    out = catalog.where("idx_scan = 0").select("index_name", "table_name", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), F.lit("PG_IDX_014").alias("rule_id"))
    return out.orderBy(F.desc("size_bytes"), "index_name")


def sizes(catalog: DataFrame) -> DataFrame:
    return catalog.where("size_bytes is not null").select("index_name", "table_name", "size_bytes").orderBy(F.desc_nulls_last("size_bytes"), "index_name")


def plan_metrics(plan: Column) -> dict[str, Column]:
    """Counts and figures of a plan's text. 'Index Only Scan' is no index scan here, 'Bitmap Index Scan' is one."""
    return {
        "seq_scans": F.regexp_count(plan, F.lit(r"Seq\s+Scan")).cast("long"),
        "index_scans": F.regexp_count(plan, F.lit(r"Index\s+Scan")).cast("long"),
        "rows": F.regexp_extract(plan, r"rows=(\d+)", 1).try_cast("long"),
        "ms": F.regexp_extract(plan, r"Execution Time:\s*([\d.]+)\s*ms", 1).try_cast("double"),
    }
