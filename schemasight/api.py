"""What a user calls: each function takes a directory or a table and returns DataFrames, or writes a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight import registry
from schemasight.functions import text as T
from schemasight.operators import compare as C
from schemasight.operators import discovery as D
from schemasight.operators import lines as L
from schemasight.operators import reports as W
from schemasight.operators import rules as R
from schemasight.operators import scripts as P
from schemasight.operators import suggest as G
from schemasight.operators import teams as M
from schemasight.plans import scan as plans
from schemasight import sinks
from schemasight.shared import settle
from schemasight.sources import configuration, files

#: The rule families that can be run by themselves.
FAMILIES = {
    "migrations": [registry.MIGRATION, registry.BLOCKED],
    "schema": [registry.SCHEMA],
    "indexes": [registry.INDEX],
    "performance": [registry.PERFORMANCE],
    "application": [registry.APPLICATION],
}
FORMATS = {"mongo_shell": P.mongo_shell, "pymongo": P.pymongo, "postgresql": P.postgres, "sql": P.postgres}


def _index_lines(found: DataFrame) -> DataFrame:
    """Index lines of files (id, path, name, content): path is what decides, id is kept."""
    found = files.by_category(found).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, registry.SKIP_DIRS))))
    out = None
    for family, categories in (("java", ["java"]), ("script", ["python", "javascript"]), ("config", ["config"])):
        part = L.scan_lines(files.lines(found.where(F.col("category").isin(categories)), "id"), registry.INDEX_LINES[family])
        out = part if out is None else out.unionByName(part)
    return out


def index_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all known languages that declare or mention an index, by the patterns of their family. No other files are read."""
    return _index_lines(files.files(spark, root, endings=sum(registry.CATEGORIES.values(), [])).withColumn("id", F.col("path")))


def indexes(spark: SparkSession, root: str) -> DataFrame:
    return plans.scan_indexes(spark, root)["indexes"]


def suggestions(spark: SparkSession, root: str) -> DataFrame:
    return plans.scan_indexes(spark, root)["suggestions"]


def projects(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Index lines of several projects, with the project and, in a row without one, all of them counted by type. One read, whatever their number."""
    found = files.decoded(files.tree(spark, roots, [], sum(registry.CATEGORIES.values(), [])))
    found = _index_lines(found.withColumn("id", F.concat_ws("\u0001", "root", "path")))
    out = found.withColumn("project", F.substring_index("file_id", "\u0001", 1))
    return out.rollup("project", "type").agg(F.count("*").alias("n"))


def script_usages(spark: SparkSession, root: str) -> DataFrame:
    """What the older analysis finds in the Java, Kotlin, Python, JavaScript and TypeScript files of a project."""
    found = files.files(spark, root, endings=registry.CATEGORIES["java"]).where(~T.in_skipped_dir(F.col("path"), tests=False))
    code = files.lines(found)
    scripts = files.lines(files.script_sources(spark, root))
    older = L.older_findings(code, registry.OLDER_FIELDS, registry.OLDER_OPERATIONS)
    return older.unionByName(L.older_findings(scripts, registry.SCRIPT_FIELDS, registry.SCRIPT_OPERATIONS))


def older_suggestions(spark: SparkSession, root: str, n: int | None = None) -> DataFrame:
    """Suggestions from these, or the first ``n`` of them."""
    found = G.legacy_suggestions(script_usages(spark, root))
    return found if n is None else W.top(found, n)


def databases(spark: SparkSession, root: str, deployed: bool = False) -> DataFrame:
    """The databases that a project, or a repository of deployment settings, names, in the order in which they are seen: (name, path)."""
    if deployed:
        out = D.deployed_databases(files.files(spark, root, names=registry.DEPLOY_FILES, endings=registry.DEPLOY_EXTENSIONS))
    else:
        out = D.database_names(files.setting_sources(spark, root), L.constants_map(files.constants(files.constant_sources(spark, root))))
    return out.orderBy("seq").select("name", "path")


def search(spark: SparkSession, root: str, words: str) -> DataFrame:
    """Declared indexes and suggestions in whose collection, fields or kind the words occur, without regard to case."""
    found = plans.scan_indexes(spark, root)
    both = found["indexes"].select(F.lit("index").alias("what"), "collection", "fields", "kind").unionByName(found["suggestions"].select(F.lit("suggestion").alias("what"), "collection", "fields", "kind"))
    return both.where(F.contains(F.lower(F.concat_ws(" ", "collection", "fields", "kind")), F.lit(words.lower())))


def specifications(spark: SparkSession, root: str) -> DataFrame:
    """Declared indexes and suggestions in the form that the script writers take."""
    found = plans.scan_indexes(spark, root)
    parts = F.transform(F.split("fields", ","), lambda f: F.struct(F.element_at(F.split(f, ":"), 1).alias("name"), F.when(F.size(F.split(f, ":")) > 1, F.element_at(F.split(f, ":"), 2)).otherwise("1").alias("dir")))
    rows = found["indexes"].select("database", "collection", F.col("name").alias("index_name"), parts.alias("fields"), "unique", "sparse", "ttl")
    no = F.lit(False)
    more = found["suggestions"].select("database", "collection", F.lit("suggested").alias("index_name"), parts.alias("fields"), no.alias("unique"), no.alias("sparse"), F.lit(None).cast("int").alias("ttl"))
    return rows.unionByName(more.distinct())


def export(spark: SparkSession, root: str, form: str = "mongo_shell", database: str | None = None) -> DataFrame:
    """Lines of a script that creates what the code declares and its queries need, sorted by collection."""
    if form not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    specs = specifications(spark, root)
    out = P.postgres(specs, database or "public") if form in ("postgresql", "sql") else FORMATS[form](specs)
    return out.orderBy("collection", "line")


def script(spark: SparkSession, root: str, form: str = "mongo_shell", database: str | None = None) -> DataFrame:
    """A whole script with its head, its databases and its collections, in order: (line)."""
    specs = specifications(spark, root).withColumn("seq", F.xxhash64("collection", "fields", "index_name"))
    out = P.shell_script(specs, database) if form == "mongo_shell" else P.pymongo_script(specs, database or "mydb")
    order = [F.col(c).asc_nulls_first() for c in ("database", "collection", "part", "seq") if c in out.columns]
    return out.orderBy(order).select("line")


def check(spark: SparkSession, root: str, family: str | None = None, config: str | None = None) -> dict[str, DataFrame]:
    """violations and gate of all rules or of one family."""
    out = plans.check(spark, root, configuration.load_config(config))
    if family is None:
        return out
    kept = out["violations"].where(F.col("category").isin(FAMILIES[family]))
    return {"violations": kept, "gate": R.gate(kept), "by_file": R.gate(kept, "file_id")}


def compare_script(spark: SparkSession, root: str, script: DataFrame) -> DataFrame:
    """A script, as (content) or its lines (line), against the indexes and suggestions of the code; shell and pymongo calls are read."""
    mine = specifications(spark, root).select("collection", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["dir"])), ",").alias("fields"))
    text = script.agg(F.array_join(F.collect_list("line"), "\n").alias("content")) if "line" in script.columns else script
    return C.compared(P.script_calls(text.withColumn("file_id", F.lit("script")))[["collection", "fields"]], mine)


def compare_live(spark: SparkSession, root: str, live: DataFrame) -> DataFrame:
    """Suggestions against a snapshot of live indexes (collection, cols): exists or missing."""
    wanted = suggestions(spark, root).select(F.xxhash64("file_id", "collection", "fields").alias("id"), "collection", F.split("fields", ",").alias("cols"), "priority")
    return C.covered_documents(wanted, live)


def postgres_catalog(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Live indexes of a PostgreSQL server by Spark's JDBC source: (table_name, index_name, definition)."""
    query = "SELECT tablename AS table_name, indexname AS index_name, indexdef AS definition FROM pg_indexes WHERE schemaname NOT IN ('pg_catalog', 'information_schema')"
    return spark.read.format("jdbc").options(url=url, query=query, connectTimeout="10", **options).load()


def postgres_usage(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Size and scans of the live indexes, as ``operators.teams`` takes them."""
    query = "SELECT relname AS table_name, indexrelname AS index_name, pg_relation_size(indexrelid) AS size_bytes, idx_scan FROM pg_stat_user_indexes"
    return spark.read.format("jdbc").options(url=url, query=query, connectTimeout="10", **options).load()


def runtime_violations(spark: SparkSession, config: str | None = None) -> DataFrame | None:
    """Indexes that the server of the configured connection never used (PG_IDX_014), the largest first; None without a connection, nothing if the rule is disabled."""
    settings = configuration.load_config(config)
    if settings.connection is None:
        return None
    found = M.unused(postgres_usage(spark, **configuration.jdbc_options(settings.connection)))
    return found.where(~F.col("rule_id").isin(settings.disabled_rules)) if settings.disabled_rules else found


def team_services(spark: SparkSession, catalog: str, team: str) -> DataFrame:
    return M.with_kinds(M.of_team(configuration.catalog(spark, catalog), team))


def check_team(spark: SparkSession, catalog: str, team: str, base: str = "", config: str | None = None) -> dict[str, DataFrame]:
    """Violations of all services of a team that have a repository, by service and in all. A service is a directory; all are read and judged in one pass."""
    services = team_services(spark, catalog, team).where("has_path and supported").select(F.col("service_name").alias("service"), F.concat(F.lit(base), "uri_location").alias("root")).distinct()
    roots = sorted({r["root"] for r in services.select("root").collect()})
    if not roots:
        return {}
    found = plans.check(spark, roots, configuration.load_config(config))["violations"]
    # a file belongs to the services whose root is one of its directories
    parts = F.split("file_id", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    plain = services.select("service", F.rtrim(F.element_at(F.split("root", "://"), -1), F.lit("/")).alias("root"))
    found = found.withColumn("root", F.explode(above)).join(plain, "root").drop("root")
    return {"violations": found, "gate": R.gate_with_total(found, "service")}


def check_team_report(spark: SparkSession, catalog: str, team: str, path: str, base: str = "", config: str | None = None) -> dict[str, DataFrame]:
    """Check a team's services and write, below ``path``, violations and gates as JSON, a directory a service, and a page for each service with one of all."""
    out = {name: settle(df) for name, df in check_team(spark, catalog, team, base, config).items()}
    if out:
        sinks.write_json(out["violations"], f"{path}/violations", "service")
        sinks.write_json(out["gate"], f"{path}/gate")
        sinks.write_services(out["violations"], out["gate"], f"{path}/html")
    return out


def check_report(spark: SparkSession, root: str, path: str, config: str | None = None) -> dict[str, DataFrame]:
    """Check a project and write the report with its gate, summary, violations and errors as JSON lines, a directory a section."""
    out = check(spark, root, None, config)
    found = W.gate_report(root, out["violations"], out["gate"], files.unreadable(spark, root), files.paths(spark, root))
    found.write.mode("overwrite").partitionBy("section").text(path)
    return out


def report(df: DataFrame, path: str) -> None:
    """A JSON report of any of these tables."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def usage_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The older rollup over all files of a project."""
    constants = L.constants_map(files.constants(files.constant_sources(spark, root)))
    return G.legacy_suggestions(L.field_usages(files.lines(files.java_sources(spark, root)), constants))
