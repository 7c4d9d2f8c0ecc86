"""Registry of the engine's own queries on the driver's tables; their DuckDB counterparts are in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight.corpus import register
from schemasight.functions import sqltext as S
from schemasight.functions import tablesql as K
from schemasight.functions import text as T
from schemasight.operators import compare as C
from schemasight.operators import discovery as D
from schemasight.operators import indexes as I
from schemasight.operators import lines as L
from schemasight.operators import plantree as Q
from schemasight.operators import references as N
from schemasight.operators import reports as W
from schemasight.operators import rules as R
from schemasight.operators import scripts as P
from schemasight.operators import suggest as G
from schemasight.operators import teams as M
from schemasight.oracle import ORACLE  # noqa: F401
from schemasight.registry import INDEX_LINES, MIGRATION, OLDER_FIELDS, OLDER_OPERATIONS, SCRIPT_FIELDS, SCRIPT_OPERATIONS
from schemasight.shared import settle
from schemasight.sources import annotations as A
from schemasight.sources import configuration as E

QUERIES: dict = {}


def query(f):
    """Register ``f(view)``, where view gives a corpus or table by its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(register(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def constants(view):
    return L.constants_map(view("constants_kv"))


def usages(view):
    """The field usages, settled: most queries read them more than once."""
    return settle(L.field_usages(view("java_lines"), constants(view)))


def defs(view):
    return view("index_defs").withColumn("cols", F.split("cols", ","))


def documents_as_lines(view):
    return view("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line_no"), "text")


# lines


@query
def line_scan(view):
    return L.scan_lines(view("java_lines"), INDEX_LINES["java"]).select("file_id", "line_no", "type", "match")


@query
def context_window(view):
    return L.with_context(documents_as_lines(view)).select("file_id", "line_no", F.md5("context").alias("context"))


@query
def line_offsets(view):
    return L.with_offset(documents_as_lines(view)).select("file_id", "line_no", "start")


@query
def comment_skip(view):
    return view("java_lines").where(~T.is_comment(F.col("text"), "//", "*")).groupBy("file_id").agg(F.count("*").alias("n"))


@query
def first_pattern_wins(view):
    return view("java_lines").select("file_id", "line_no", T.first_match(F.col("text"), INDEX_LINES["java"], "(?i)").alias("type")).where("type is not null")


@query
def keyword_search(view):
    c = view("conversations")
    return c.where(F.contains(F.lower(F.concat_ws(" ", "role", "text")), F.lit("the"))).select("conv_id", "turn", "role")


@query
def count_by_type(view):
    return L.scan_lines(view("java_lines"), INDEX_LINES["java"]).groupBy("type").agg(F.count("*").alias("n"))


@query
def group_by_file(view):
    found = L.scan_lines(view("java_lines"), INDEX_LINES["java"])
    return found.groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("lines"))


@query
def constants_lookup(view):
    return constants(view)


@query
def resolve_constants(view):
    names = view("orders").select(F.concat(F.lit("F"), (F.col("o_orderkey") % 30).cast("string")).alias("name"))
    return L.resolved(names, constants(view)).groupBy("name", "value").agg(F.count("*").alias("n"))


@query
def asof_operation(view):
    return L.operation_of(view("java_lines")).select("file_id", "line_no", "operation")


@query
def asof_collection(view):
    return L.collection_of(view("java_lines"), constants(view)).select("file_id", "line_no", "collection")


# suggestions


@query
def field_usages(view):
    return L.field_usages(view("java_lines"), constants(view))


@query
def collection_filter(view):
    return view("documents").select(F.col("doc_id"), F.split("text", r"\s+").alias("w")).select("doc_id", F.explode("w").alias("name")).where(~T.is_skipped_collection(F.col("name"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def db_name_validity(view):
    words = view("documents").select("doc_id", F.explode(F.split("text", " ")).alias("name"))
    return words.where(words["name"].rlike("^[A-Za-z]+$")).groupBy("doc_id").agg(F.count_if(T.is_database_name(F.col("name"))).alias("valid"), F.count("*").alias("n"))


@query
def single_suggestions(view):
    return G.single_fields(usages(view))


@query
def compound_esr(view):
    return G.compound_fields(usages(view))


@query
def low_subset_prune(view):
    u = usages(view)
    return G.without_covered_singles(G.single_fields(u), G.compound_fields(u)).select("file_id", "collection", "fields", "priority")


@query
def suggestions_ranked(view):
    return G.suggestions(usages(view))


@query
def suggestion_antijoin(view):
    singles = G.single_fields(usages(view)).select("file_id", "collection", "fields", "priority")
    declared = view("nation").select(F.lit("clicks").alias("collection"), F.concat(F.lit("f"), (F.col("n_nationkey") % 4).cast("string")).alias("fields"))
    return G.without_indexed(singles, declared)


@query
def index_dedup(view):
    d = view("index_defs").select(F.col("table_name").alias("collection"), F.col("cols").alias("fields"), (F.col("seq") % 2 == 0).alias("unique"), F.lit(False).alias("sparse"), F.lit(None).cast("int").alias("ttl"), "seq", "index_name")
    return G.first_of_equals(d).select("collection", "index_name")


@query
def usage_stats(view):
    return usages(view).agg(F.count("*").alias("n"), F.count_distinct("collection").alias("collections"), F.count_distinct("field").alias("fields"), F.count_distinct("file_id").alias("files"))


@query
def legacy_suggestions(view):
    return G.legacy_suggestions(usages(view))


# statements


@query
def stmt_classify(view):
    return R.typed(view("sql_statements")).select("file_id", "stmt_no", "type")


@query
def stmt_target(view):
    return R.typed(view("sql_statements")).select("file_id", "stmt_no", "target")


@query
def create_index_parse(view):
    d = view("sql_statements").where(S.statement_type(F.col("raw_sql")) == "CREATE INDEX")
    p = S.index_parts(F.col("raw_sql"))
    return d.select("file_id", "stmt_no", *[(F.array_join(c, ",") if k == "columns" else c).alias(k) for k, c in p.items()])


def column_query(name, f):
    def run(view):
        d = R.typed(view("sql_statements")).where(F.col("type").isin("SELECT", "UPDATE", "DELETE"))
        return d.select("file_id", "stmt_no", F.array_join(f(F.col("raw_sql")), ",").alias("names"))

    run.__name__ = name
    query(run)


for _name, _f in (("query_tables", S.tables), ("where_columns", S.where_columns), ("join_columns", S.join_columns), ("orderby_columns", S.order_columns)):
    column_query(_name, _f)


@query
def query_flags(view):
    d = R.typed(view("sql_statements")).where(F.col("type").isin("SELECT", "UPDATE", "DELETE"))
    return d.select("file_id", "stmt_no", *[(F.coalesce(c, F.lit(-1)) if k == "offset" else c).alias(k) for k, c in S.query_flags(F.col("raw_sql")).items()])


@query
def data_type_class(view):
    d = view("ddl_columns").withColumn("definition", F.concat(F.col("data_type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL")))
    return d.groupBy(S.data_type(F.col("definition")).alias("data_type")).agg(F.count("*").alias("n"))


@query
def stmt_split(view):
    """Scripts are put together from statements with comments and quoted semicolons between, and split again."""
    s = view("sql_statements").withColumn("text", F.concat(F.lit("/* ; */ "), "raw_sql", F.lit("\n-- ; 'x\n")))
    files = s.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt_no", "text"))), lambda x: x["text"]), ";").alias("content"))
    out = files.select("file_id", F.explode(S.split_sql(F.col("content"))).alias("s")).select("file_id", F.col("s.stmt_no").alias("stmt_no"), F.col("s.line_no").alias("line_no"), S.bare(F.col("s.raw_sql")).alias("raw_sql"))
    return out.withColumn("raw_sql", F.regexp_replace("raw_sql", r"\s*-- ; 'x\s*$", ""))


@query
def create_table_parse(view):
    """Tables are rendered as CREATE TABLE statements and parsed again."""
    c = view("ddl_columns").withColumn("part", F.concat_ws(" ", "name", "data_type", F.when(~F.col("nullable"), "NOT NULL"), F.when(F.col("has_default"), "DEFAULT (1, 2)")))
    t = c.groupBy("table_name").agg(F.concat(F.lit("CREATE TABLE x ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), ", "), F.lit(") WITH (a=1)")).alias("sql"))
    p = t.select("table_name", F.posexplode(S.table_parts(F.col("sql"))).alias("pos", "part"))
    name = F.regexp_extract("part", r"^(\S+)", 1)
    rest = F.regexp_extract("part", r"^\S+\s+(.*)$", 1)
    return p.select("table_name", (F.col("pos") + 1).alias("ord"), name.alias("name"), S.data_type(rest).alias("data_type"), (~F.upper("part").contains("NOT NULL")).alias("nullable"), F.upper("part").contains("DEFAULT").alias("has_default"))


@query
def table_constraints(view):
    """The constraints of CREATE TABLE statements, of tables and of columns."""
    found = view("table_scripts").select("n", F.explode(K.table_constraints(F.col("sql"))).alias("c")).select("n", "c.*")
    return found.withColumn("columns", F.array_join("columns", ",")).withColumn("target_columns", F.array_join("target_columns", ","))


# rules


def violations(view):
    s = settle(R.typed(view("sql_statements")))  # once for the three families of rules
    parts = [
        R.migration_rules(s).select("file_id", "line_no", "rule_id"),
        R.multiple_ddl(s).select("file_id", "line_no", F.lit("PG-MIG-006").alias("rule_id")),
        R.query_rules(s).select("file_id", "line_no", "rule_id"),
        R.code_rules(view("java_lines")).select("file_id", "line_no", "rule_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def judged(view, **options):
    found = violations(view)
    return R.configured(found, R.catalog(found.sparkSession), **options)


@query
def mig_rules(view):
    return R.migration_rules(view("sql_statements"))


@query
def mig_multi_ddl(view):
    return R.multiple_ddl(view("sql_statements"))


@query
def mig_rollback(view):
    return R.without_rollback(view("migration_files"))


@query
def mig_autofix(view):
    d = R.migration_rules(view("sql_statements")).where("rule_id = 'PG-MIG-007'").join(view("sql_statements"), ["file_id", "line_no"])
    return d.select("file_id", "stmt_no", S.with_concurrently(F.col("raw_sql")).alias("fixed"))


@query
def schema_columns(view):
    return R.column_rules(view("ddl_columns"))


@query
def schema_keys(view):
    return R.key_rules(view("ddl_columns"))


@query
def schema_missing_fk(view):
    return R.missing_foreign_keys(view("ddl_columns"))


@query
def schema_fk_cycles(view):
    return R.foreign_key_cycles(view("fk_edges"))


@query
def idx_fk_uncovered(view):
    keys = view("fk_edges").select("src", "cols").distinct().select(F.col("src").alias("table_name"), F.array("cols").alias("fk_cols"))
    return I.uncovered_keys(keys, defs(view)).select("table_name", F.array_join("fk_cols", ",").alias("fk_cols"))


@query
def idx_duplicates(view):
    return I.duplicates(defs(view))


@query
def idx_prefix(view):
    """Every pair of indexes of which one's columns begin the other's."""
    return I.prefixes(defs(view))


@query
def idx_prefix_pairs(view):
    """The same under its longer name."""
    return I.prefixes(defs(view))


@query
def idx_prefix_classes(view):
    """Column lists that others begin with or that begin with others, by class."""
    return I.prefix_classes(defs(view)).withColumn("cols", F.array_join("cols", ","))


@query
def idx_wide(view):
    return I.too_wide(defs(view))


@query
def idx_column_order(view):
    d = defs(view).withColumn("cols", F.transform("cols", lambda c: F.when(c == "c0", "created_at").when(c == "c1", "vendor").otherwise(c)))
    return I.misordered(d)


@query
def idx_naming(view):
    return I.misnamed(view("index_defs"), "ix_[0-9]*[05]")


@query
def perf_all(view):
    return R.query_rules(view("sql_statements"))


@query
def app_all(view):
    return R.code_rules(view("java_lines"))


@query
def app_stmt_vars(view):
    return R.statement_variables(view("java_lines"))


@query
def rule_overrides(view):
    d = judged(view, disabled=["PERF003"], overrides={"PG-MIG-001": "High", "PG-BLK-006": "Critical", "APP001": "Medium", "PERF001": "Low"})
    return d.groupBy("rule_id", "severity", "action").agg(F.count("*").alias("n"))


@query
def violations_union(view):
    return violations(view).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


@query
def gate(view):
    return R.gate(judged(view))


@query
def gate_empty(view):
    return R.gate(judged(view).where("rule_id = 'none'"))


@query
def gate_by_file(view):
    return R.gate(judged(view), "file_id")


@query
def gate_with_total(view):
    return R.gate_with_total(judged(view).withColumn("service", F.concat(F.lit("s"), (F.col("file_id") % 7).cast("string"))), "service")


@query
def by_category(view):
    return judged(view).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("critical"))


@query
def first_violations(view):
    return R.first_lines(judged(view).where(F.col("category") == MIGRATION).select("file_id", "line_no", "rule_id"), 2, "rule_id")


# teams and catalogs


@query
def catalog_filter(view):
    return M.of_team(view("service_catalog"), "team nation_3").select("service_name", "namespace")


@query
def catalog_kinds(view):
    return M.with_kinds(view("service_catalog")).groupBy("team", "has_postgres", "has_mongodb", "has_path", "supported").agg(F.count("*").alias("n"))


@query
def distinct_teams(view):
    return M.team_names(view("service_catalog"))


@query
def team_rollup(view):
    return M.rollup(M.with_kinds(view("service_catalog")))


@query
def db_connections(view):
    return M.connections(view("env_vars"))


@query
def uri_parse(view):
    return view("env_vars").select("service", "key", *[(F.coalesce(c, F.lit(0)) if k == "port" else c).alias(k) for k, c in T.database_uri(F.col("value")).items()])


@query
def unused_indexes(view):
    return M.unused(view("live_catalog"))


@query
def index_sizes(view):
    return M.sizes(view("live_catalog"))


@query
def plan_metrics(view):
    return view("plans").select("query_id", *[c.alias(k) for k, c in M.plan_metrics(F.col("plan_text")).items()])


@query
def plan_nodes(view):
    return Q.plan_nodes(view("plan_trees"))


@query
def slowest_nodes(view):
    return Q.slowest_nodes(Q.plan_nodes(view("plan_trees")))


@query
def flattened_settings(view):
    return E.settings(view("yaml_files")).select("service", "key", "value")


# texts and reports


@query
def text_lines(view):
    parts = T.split_lines(F.col("text"))
    return view("mixed_ends").select("doc_id", F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.md5(F.coalesce(F.array_join(parts, "|"), F.lit(""))).alias("lines"))


@query
def path_parts(view):
    path = F.col("path")
    return view("project_files").select("path", T.base_name(path).alias("name"), T.stem(path).alias("stem"), T.extension(path).alias("extension"), T.safe_name(path).alias("safe"), T.in_skipped_dir(path).alias("skipped"), T.in_skipped_dir(path, tests=False).alias("skipped_as_project"))


@query
def escaped_pages(view):
    escaped = T.escape_html(F.col("html"))
    return view("pages").select("page_id", F.length(escaped).cast("long").alias("n"), F.md5(escaped).alias("escaped"))


@query
def table_lines(view):
    return W.table_lines(view("documents"), {"doc_id": 8, "source": 12, "text": W.WIDEST}).select("doc_id", "table_line")


# comparisons


def halves(view):
    d = view("index_defs").select(F.col("table_name").alias("collection"), F.col("cols").alias("fields"), "index_name", "seq")
    return d.where("seq % 3 < 2"), d.where("seq % 3 > 0")


@query
def script_compare(view):
    script, code = halves(view)
    return C.compared(script, code)


@query
def code_union(view):
    code, suggested = halves(view)
    return C.combined(code, suggested)


def live_indexes(view):
    """A live index for each part, on the tables that index_defs names."""
    numbers = [F.col("p_size"), F.length("p_name"), F.col("p_partkey"), F.length("p_type")]
    cols = F.array(*[F.concat(F.lit("c"), (n % 4).cast("string")) for n in numbers])
    return view("part").select(F.concat(F.lit("t"), (F.col("p_partkey") % 50).cast("string")).alias("table_name"), cols.alias("cols"))


@query
def pg_coverage(view):
    wanted = defs(view).select(F.col("seq").alias("id"), "table_name", "cols")
    return C.covered_sql(wanted, live_indexes(view)).select("id", "status")


@query
def doc_coverage(view):
    wanted = defs(view).select(F.col("seq").alias("id"), F.col("table_name").alias("collection"), "cols")
    return C.covered_documents(wanted, live_indexes(view).withColumnRenamed("table_name", "collection")).select("id", "status")


@query
def tenant_expansion(view):
    names = view("nation").select(F.lower("n_name").alias("name"))
    live = view("customer").join(view("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat((F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "_").when(F.col("c_custkey") % 3 == 1, "-").otherwise(""), F.lower("n_name")).alias("live"))
    return C.tenants(names, live.distinct())


@query
def compare_eligibility(view):
    suggested = view("index_defs").groupBy(F.col("table_name").alias("collection")).agg(F.count("*").alias("n"))
    sizes = view("part").groupBy(F.concat(F.lit("t"), (F.col("p_partkey") % 45).cast("string")).alias("collection")).agg(F.count_if(F.col("p_size") > 20).alias("docs"))
    return C.eligibility(suggested, sizes)


@query
def esr_analysis(view):
    d = defs(view).withColumnRenamed("table_name", "collection").where(F.size("cols") > 1)
    u = view("index_defs").select(F.col("table_name").alias("collection"), F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")).alias("field"), F.when(F.col("seq") % 7 == 0, "sort").when(F.col("seq") % 5 == 0, "range").otherwise("equality").alias("usage"))
    return C.esr(d, u)


@query
def create_plan(view):
    databases = view("region").select(F.lower("r_name").alias("database"))
    return C.creation_plan(databases, view("index_defs").select("table_name", "index_name"))


# scripts


@query
def mongo_shell_lines(view):
    return P.mongo_shell(P.specs(view("index_defs")))


@query
def pymongo_lines(view):
    return P.pymongo(P.specs(view("index_defs")))


@query
def pg_ddl_lines(view):
    return P.postgres(P.specs(view("index_defs")))


@query
def verify_lines(view):
    return P.verification(P.specs(view("index_defs")))


@query
def pg_indexdef_parse(view):
    d = P.postgres(P.specs(view("index_defs")))
    return d.select("index_name", P.indexdef_columns(F.col("line")).alias("columns"))


@query
def script_parse(view):
    return P.parsed_shell(P.mongo_shell(P.specs(view("index_defs"))))


# scripts in other languages, the older analysis, whole files


@query
def script_usages(view):
    return L.older_findings(view("script_lines"), SCRIPT_FIELDS, SCRIPT_OPERATIONS)


@query
def older_findings(view):
    return L.older_findings(view("java_lines"), OLDER_FIELDS, OLDER_OPERATIONS)


@query
def collection_whole_file(view):
    lines = L.with_offset(view("java_lines"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    refs = N.named(N.references(view("java_lines").groupBy("file_id").agg(content.alias("content"))), constants(view))
    return N.collection_at(lines, refs).select("file_id", "line_no", "collection")


# classes


@query
def declared_indexes(view):
    return A.declared(view("java_classes")).drop("seq")


@query
def special_indexes(view):
    """Indexes of the four special kinds."""
    return A.declared(view("annotated_classes")).where("kind <> 'compound'").drop("seq")


@query
def resolved_compounds(view):
    """Compounds with the values of constants for their names."""
    found = A.with_constants(A.declared(view("annotated_classes")), L.constants_map(view("constants_kv")))
    return found.where("kind = 'compound'").select("path", "collection", "fields", "name", "sparse")


@query
def annotation_errors(view):
    return A.misdeclared(view("annotated_classes"))


@query
def standalone_compound(view):
    return A.standalone(view("java_classes"))


@query
def forward_field(view):
    return A.next_fields(view("java_classes"))


# discovery


@query
def discover_by_category(view):
    return D.categorised(view("project_files")).select("path", "category")


@query
def non_query_filter(view):
    return D.query_files(view("project_files")).select("path")


@query
def config_db_names(view):
    named = constants(view).withColumn("name", F.concat(F.lit("DB_NAME_"), "name"))
    return D.database_names(view("setting_files"), named).select("name", "path")


@query
def deployed_db_names(view):
    return D.deployed_databases(view("deploy_files")).select("name", "path")


@query
def primary_db_fill(view):
    found = view("index_defs").select("table_name", "index_name", F.when(F.col("seq") % 3 == 0, "own").alias("database"))
    return D.with_primary_database(found, D.database_names(view("setting_files")))


def service_values(view):
    path = F.concat(F.lit("svc"), (F.col("c_custkey") % 40).cast("string"), F.lit("/values.yaml"))
    return view("customer").select(F.col("c_name").alias("service_name"), F.when(F.col("c_custkey") % 7 == 0, "Service Not Found").otherwise(path).alias("uri_location"))


@query
def values_of_catalog(view):
    return D.values_files(view("values_paths"), service_values(view))


@query
def values_discovered(view):
    return D.values_files(view("values_paths"))


def one_of(number, *names):
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


@query
def connection_keys(view):
    keys = one_of(F.col("c_custkey"), "Spring.Data-MongoDB.uri", "DATABASE_URL", "db-host", "MONGO.DATABASE", "other")
    return view("customer").select(keys.alias("key")).withColumn("kind", D.key_kind(F.col("key"))).groupBy("key", "kind").agg(F.count("*").alias("n"))


@query
def name_antijoin(view):
    named = view("index_defs").select("table_name", F.concat(F.lit("n"), (F.col("seq") % 97).cast("string")).alias("index_name"), "seq")
    return D.first_by_name(named, "table_name")


@query
def catalog_by_namespace(view):
    return M.selected(view("service_catalog"), namespace=" europe ", sub_team="SUB").select("service_name")


@query
def services_violations(view):
    v = judged(view).join(view("customer"), F.col("file_id") == F.col("c_custkey")).select("rule_id", F.concat(F.lit("git/"), "c_name").alias("project"))
    return M.by_service(v, view("service_catalog")).groupBy("service_name").agg(F.count("*").alias("n"))


# reports


@query
def status_counts(view):
    status = one_of(F.col("o_orderkey"), "created", "exists", "error")
    return W.status_counts(view("orders").select(status.alias("status")), "created", "exists", "error")


@query
def compare_summary(view):
    script, code = halves(view)
    return W.comparison_summary(C.compared(script, code))


@query
def default_index_skip(view):
    fields = F.when(F.col("p_size") % 3 == 0, "_id:1").otherwise("_id:1,a:1")
    database = F.when(F.col("p_partkey") % 4 == 0, "admin").otherwise("shop")
    return C.without_default(view("part").select("p_partkey", fields.alias("fields"), database.alias("database")))


@query
def top_suggestions(view):
    return W.top(G.legacy_suggestions(usages(view)))


@query
def line_report(view):
    return W.line_report(L.scan_lines(view("java_lines"), INDEX_LINES["java"]))


@query
def scan_summary(view):
    return W.scan_summary(A.declared(view("java_classes")), G.suggestions(usages(view)))


@query
def json_report(view):
    """The report's lines, counted by section and by what is read back from the JSON."""
    v = judged(view)
    errors = view("orders").select(F.concat(F.lit("e"), "o_orderkey").alias("error"))
    out = W.gate_report("p", v, R.gate(v), errors, view("project_files"))
    value = F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in ("rule_id", "java_files_scanned", "total_violations")])
    return out.groupBy("section", value.alias("value")).agg(F.count("*").alias("n"))


@query
def first_errors(view):
    return W.first_errors(view("orders").select((F.col("o_custkey") % 10).alias("project"), F.concat(F.lit("e"), "o_orderkey").alias("error")), 5, "project")


@query
def esr_recommendation(view):
    found = esr_analysis(view)
    return found.select("collection", "index_name", C.reordering(F.col("classes"), F.col("better"), F.col("compliant")).alias("advice"))


def script_specs(view):
    s = F.col("seq")
    direction = lambda c: F.when(c == "c3", "-1").when(c == "c2", "text").otherwise("1")
    fields = F.transform(F.array_distinct(F.split("cols", ",")), lambda c: F.struct(c.alias("name"), direction(c).alias("dir")))
    database = F.when(s % 3 > 0, F.concat(F.lit("db"), (s % 3).cast("string")))
    options = [(s % 4 == 0).alias("unique"), (s % 5 == 0).alias("sparse"), F.when(s % 6 == 0, s % 100).cast("int").alias("ttl")]
    return view("index_defs").select(database.alias("database"), F.col("table_name").alias("collection"), "seq", fields.alias("fields"), *options)


@query
def mongo_script(view):
    return P.shell_script(script_specs(view))


@query
def pymongo_script(view):
    return P.pymongo_script(script_specs(view))


@query
def shell_keys(view):
    text = F.concat(F.lit("{a"), F.col("p_partkey").cast("string"), F.lit(': 1, "b": -1, c: "text"}'))
    return view("part").select("p_partkey", P.shell_keys(text).alias("fields"))


@query
def pymongo_keys(view):
    text = F.concat(F.lit('[("a'), F.col("p_partkey").cast("string"), F.lit("""", ASCENDING), ('b', -1), ("c", TEXT), ("d", HASHED)]"""))
    return view("part").select("p_partkey", P.pymongo_keys(text).alias("fields"))


@query
def script_calls(view):
    return P.script_calls(view("index_scripts"))
