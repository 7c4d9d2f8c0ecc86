"""Whole pipelines over a directory of projects: indexes and suggestions, and the rule check with its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight.functions import sqltext as S
from schemasight.functions import tablesql as K
from schemasight.functions.text import LINE_END
from schemasight.operators import discovery as D
from schemasight.operators import indexes as I
from schemasight.operators import lines as L
from schemasight.operators import references as N
from schemasight.operators import rules as R
from schemasight.operators import suggest as G
from schemasight.sources import annotations as A
from schemasight.sources import files as X
from schemasight.shared import settle
from schemasight.sources.configuration import Config


def usages_of(spark: SparkSession, root: str, constants: DataFrame) -> DataFrame:
    """Field usages of a project's Java queries; collections are looked for in whole files. Settled, since several operators read them."""
    code = X.java_sources(spark, root, queries_only=True).withColumn("content", F.regexp_replace("content", LINE_END, "\n"))
    code = code.select(F.col("path").alias("file_id"), "content")
    refs = N.named(N.references(code), constants)
    lines = L.with_offset(X.lines(code, "file_id"))
    return settle(L.usages_in(N.collection_at(L.operation_of(lines), refs), constants))


def scan_indexes(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """indexes (declared, without repeats), suggestions (without those that an index answers), usages and errors (annotations and files that
    can't be read) of a project; indexes and suggestions carry the database that the project names first, null if it names none."""
    constants = L.constants_map(X.constants(X.constant_sources(spark, root)))
    names = settle(D.database_names(X.setting_sources(spark, root), constants))
    sources = X.java_sources(spark, root)
    declared = settle(A.with_constants(A.declared(sources), constants))
    plain = F.array_join(F.transform(F.split("fields", ","), lambda f: F.regexp_replace(f, ":.*$", "")), ",")
    declared = G.first_of_equals(declared)
    usages = usages_of(spark, root, constants)
    found = G.without_indexed(G.suggestions(usages), declared.select("collection", plain.alias("fields")))
    return {"indexes": D.with_primary_database(declared, names), "suggestions": D.with_primary_database(found, names), "usages": usages, "errors": A.misdeclared(sources).unionByName(X.unreadable(spark, root, "*.java"))}


def schema_of(statements: DataFrame) -> dict[str, DataFrame]:
    """columns, indexes and foreign keys of the CREATE statements of scripts; all carry file_id, since files are judged one by one. UNIQUE constraints of
    tables are indexes, before those of CREATE INDEX."""
    creates = R.typed(statements).where("type = 'CREATE TABLE'").withColumn("table_name", S.target(F.col("raw_sql")))
    parts = creates.select("file_id", "line_no", "table_name", F.posexplode(S.table_parts(F.col("raw_sql"))).alias("pos", "part")).withColumn("up", F.upper("part"))
    held = settle(creates.select("file_id", "line_no", "stmt_no", "table_name", F.explode(K.table_constraints(F.col("raw_sql"))).alias("c")).select("file_id", "line_no", "stmt_no", "table_name", "c.*"))
    constraint = F.col("up").rlike(r"^(?:CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|EXCLUDE)\b")
    keyed = held.where("kind = 'PRIMARY KEY' and not inline").select("file_id", "table_name", F.col("columns").alias("pk"))
    rest = F.regexp_extract("part", r"^\S+\s+(.*)$", 1)
    plain = parts.where(~constraint).select("file_id", "line_no", "table_name", (F.col("pos") + 1).alias("ord"), S.unquoted(F.regexp_extract("part", r"^(\S+)", 1)).alias("name"), S.data_type(rest).alias("data_type"), (~F.col("up").rlike(r"NOT\s+NULL|PRIMARY\s+KEY")).alias("nullable"), F.col("up").contains("DEFAULT").alias("has_default"), F.col("up").rlike(r"PRIMARY\s+KEY").alias("_pk"))
    columns = plain.join(keyed, ["file_id", "table_name"], "left").withColumn("is_pk", F.col("_pk") | F.coalesce(F.array_contains("pk", F.col("name")), F.lit(False))).drop("_pk", "pk")
    foreign = held.where("kind = 'FOREIGN KEY' and not inline").select("file_id", "line_no", "table_name", F.col("columns").alias("fk_cols"), F.col("target").alias("dst"))
    unique = held.where("kind = 'UNIQUE' and not inline and size(columns) > 0")
    unique = unique.select("file_id", "line_no", "table_name", F.coalesce("name", F.concat_ws("_", "table_name", F.array_join("columns", "_"), F.lit("key"))).alias("index_name"), F.col("columns").alias("cols"), (F.col("stmt_no").cast("long") * 10_000 + F.col("pos")).alias("seq"))
    p = S.index_parts(F.col("raw_sql"))
    indexes = R.typed(statements).where("type = 'CREATE INDEX'").select("file_id", "line_no", p["table"].alias("table_name"), p["name"].alias("index_name"), p["columns"].alias("cols"), (F.col("stmt_no").cast("long") * 10_000 + (1 << 50)).alias("seq")).where("index_name is not null and size(cols) > 0")
    return {"columns": columns, "indexes": unique.unionByName(indexes), "foreign": foreign}


def check(spark: SparkSession, root: str | list[str], config: Config | None = None) -> dict[str, DataFrame]:
    """violations and gate of the migrations and code of a project, or of several at once. Scripts are split once, for all rules."""
    config = config or Config()
    scripts = X.migrations(spark, root)
    s = settle(R.typed(X.statements(scripts)))
    names = [config.rollback_naming_convention.replace("{migration_name}", "{0}")] if config.rollback_naming_convention else R.ROLLBACK_NAMES
    schema = schema_of(s)
    # a table's name is unique within its file only
    own = lambda df: df.withColumn("table_name", F.concat_ws("\u0001", "file_id", "table_name"))
    columns, ix = own(schema["columns"]), D.first_by_name(own(schema["indexes"]), "file_id")
    foreign = own(schema["foreign"])
    first = columns.groupBy(F.lower("table_name").alias("_table")).agg(F.min("line_no").alias("line_no"), F.first("file_id").alias("file_id"))
    by_table = lambda df, rule=None: df.join(first, F.lower(df["table_name"]) == F.col("_table")).select("file_id", first["line_no"], *(["rule_id"] if rule is None else [F.lit(rule).alias("rule_id")]))
    by_index = lambda df, rule: df.select("table_name", "index_name").join(ix.select("table_name", "index_name", "file_id", "line_no"), ["table_name", "index_name"]).select("file_id", "line_no", F.lit(rule).alias("rule_id"))
    starts = columns.where("is_pk").groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("cols"))
    covering = ix.select("table_name", "cols").unionByName(starts)
    cycles = R.foreign_key_cycles(schema["foreign"].select("file_id", F.col("table_name").alias("src"), "dst")).select("file_id", F.lit(1).alias("line_no"), F.lit("schema.circular_foreign_key").alias("rule_id"))
    likely = R.missing_foreign_keys(columns.withColumn("name", F.when(F.col("name").endswith("_id"), F.concat_ws("\u0001", "file_id", "name")).otherwise(F.col("name"))), foreign.select("table_name", F.explode("fk_cols").alias("k"), "file_id").select("table_name", F.concat_ws("\u0001", "file_id", "k").alias("name")))
    parts = [
        R.migration_rules(s).select("file_id", "line_no", "rule_id"),
        R.multiple_ddl(s).select("file_id", "line_no", F.lit("PG-MIG-006").alias("rule_id")),
        R.without_rollback(scripts.select("dir", "name"), names).select(F.concat_ws("/", F.nullif("dir", F.lit("")), "name").alias("file_id"), F.lit(0).alias("line_no"), F.lit("PG-MIG-005").alias("rule_id")),
        by_table(R.column_rules(columns, config.max_varchar_length)), by_table(R.key_rules(columns, config.max_pk_columns)), by_table(likely, "schema.missing_foreign_key"), cycles,
        by_table(I.uncovered_keys(foreign.select("table_name", "fk_cols"), covering), "IDX001"),
        by_index(I.duplicates(ix), "IDX002"), by_index(I.prefixes(ix), "IDX003"), by_index(I.too_wide(ix, config.max_index_columns), "IDX004"), by_index(I.misordered(ix), "IDX005"),
        by_index(I.misnamed(ix, config.index_naming_pattern), "IDX006") if config.index_naming_pattern else None,
        R.query_rules(s, config.max_offset).select("file_id", "line_no", "rule_id"),
    ]
    code = X.lines(X.files(spark, root, "*.java"))
    parts += [R.code_rules(code).select("file_id", "line_no", "rule_id"), R.statement_variables(code).select("file_id", "line_no", F.lit("APP002").alias("rule_id"))]
    found = None
    for p in parts:
        if p is not None:
            found = p if found is None else found.unionByName(p)
    judged = R.configured(found, R.catalog(spark), config.disabled_rules, config.severity_overrides)
    return {"violations": judged, "gate": R.gate(judged), "by_file": R.gate(judged, "file_id")}
