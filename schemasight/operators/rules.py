"""Rules on statements, columns, queries and lines; each family in one pass over its table. Violations are
(file_id, line_no, rule_id), to which the registry adds the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemasight.functions import sqltext as S
from schemasight.registry import BLOCK, BUSINESS_COLUMNS, DDL_TYPES, ROLLBACK_NAMES, RULES, SQL_WORDS, WARN
from schemasight.shared import settle


def hits(df: DataFrame, rules: list[tuple[str, Column]], *keep: str) -> DataFrame:
    """A row for each rule whose predicate holds: all predicates are evaluated in one projection."""
    found = F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("rule_id"))


def typed(statements: DataFrame) -> DataFrame:
    """Add type and target to (file_id, stmt_no, line_no, raw_sql); statements of no known type are dropped. What has a type already stays as it is."""
    if "type" in statements.columns:
        return statements
    # an explode instead of a filter: the type is computed once and not again in each predicate that is pushed down
    kind = F.explode(F.array_compact(F.array(S.statement_type(F.col("raw_sql")))))
    return statements.select("*", kind.alias("type")).withColumn("target", S.target(F.col("raw_sql")))


def migration_rules(statements: DataFrame) -> DataFrame:
    t, up = F.col("type"), F.upper("raw_sql")
    return hits(typed(statements), [
        ("PG-MIG-001", t == "DROP TABLE"), ("PG-MIG-002", t == "DROP COLUMN"), ("PG-MIG-003", t == "DROP DATABASE"), ("PG-MIG-004", t == "TRUNCATE"),
        ("PG-MIG-007", (t == "CREATE INDEX") & ~up.contains("CONCURRENTLY")), ("PG-BLK-001", (t == "VACUUM") & up.contains("FULL")), ("PG-BLK-002", t == "CLUSTER"),
        ("PG-BLK-003", (t == "REINDEX") & up.contains("SYSTEM")), ("PG-BLK-004", t == "ALTER TYPE"), ("PG-BLK-005", t == "ALTER COLUMN TYPE"),
        ("PG-BLK-006", (t == "REINDEX") & ~up.contains("SYSTEM")), ("PG-BLK-007", t == "ANALYZE"),
    ], "file_id", "line_no", "target")


def multiple_ddl(statements: DataFrame) -> DataFrame:
    """Files with more than one DDL statement: (file_id, line_no of the first, n_ddl)."""
    ddl = typed(statements).where(F.col("type").isin(DDL_TYPES))
    return ddl.groupBy("file_id").agg(F.min_by("line_no", "stmt_no").alias("line_no"), F.count("*").alias("n_ddl")).where("n_ddl > 1")


def without_rollback(files: DataFrame, names: list[str] = ROLLBACK_NAMES) -> DataFrame:
    """Migration files (dir, name) without a rollback script in their directory."""
    wanted = files.withColumn("_stem", F.regexp_replace("name", r"\.sql$", ""))
    there = files.select(F.col("dir"), F.col("name").alias("_want")).distinct()
    expected = F.array(*[F.concat(F.lit(n.split("{0}")[0]), F.col("_stem"), F.lit(n.split("{0}")[1])) for n in names])
    found = wanted.select("dir", "name", F.explode(expected).alias("_want")).join(there, ["dir", "_want"], "left_semi").select("dir", "name").distinct()
    return files.join(found, ["dir", "name"], "left_anti")


def column_rules(columns: DataFrame, longest: int = 4000) -> DataFrame:
    """Rules on single columns (table_name, ord, name, data_type, nullable, has_default, is_pk)."""
    kind, name = F.upper("data_type"), F.lower("name")
    serial = kind.isin("SERIAL", "BIGSERIAL", "SMALLSERIAL")
    length = F.regexp_extract(kind, r"^(?:VARCHAR|CHARACTER\s+VARYING)\s*\(\s*(\d+)\s*\)$", 1).try_cast("int")
    return hits(columns, [
        ("schema.json_instead_of_jsonb", kind == "JSON"), ("schema.timestamp_without_timezone", kind.startswith("TIMESTAMP") & kind.contains("WITHOUT TIME ZONE")),
        ("schema.serial_instead_of_identity", serial), ("schema.numeric_without_precision", kind.isin("NUMERIC", "DECIMAL")), ("schema.varchar_exceeds_max_length", length > longest),
        ("schema.nullable_business_column", F.col("nullable") & name.isin(BUSINESS_COLUMNS)),
        ("schema.not_null_without_default", ~F.col("nullable") & ~F.col("has_default") & ~F.col("is_pk") & ~serial & ~kind.contains("GENERATED")),
    ], "table_name", "ord", "name")


def key_rules(columns: DataFrame, most: int = 3) -> DataFrame:
    """Tables without a primary key or with one of more than ``most`` columns: (table_name, n_pk, rule_id)."""
    sizes = columns.groupBy("table_name").agg(F.count_if("is_pk").alias("n_pk"))
    return hits(sizes, [("schema.no_primary_key", F.col("n_pk") == 0), ("schema.composite_pk_too_wide", F.col("n_pk") > most)], "table_name", "n_pk")


def missing_foreign_keys(columns: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """Columns named <table>_id that are no key of their own table: (table_name, name, target)."""
    likely = columns.where(~F.col("is_pk") & F.col("name").endswith("_id")).withColumn("target", F.regexp_replace("name", "_id$", ""))
    others = columns.select(F.col("table_name").alias("target")).distinct()
    out = likely.where(F.col("target") != F.col("table_name")).join(others, "target", "left_semi")
    if foreign is not None:
        out = out.join(foreign.select("table_name", "name").distinct(), ["table_name", "name"], "left_anti")
    return out.select("table_name", "name", "target").distinct()


def on_cycles(steps: DataFrame) -> DataFrame:
    """The edges (file_id, src, dst) left when tables that lead nowhere or that nothing leads to are taken away, again and again."""
    n = steps.count()
    while n:
        ahead = steps.select("file_id", F.col("src").alias("dst")).distinct()
        behind = steps.select("file_id", F.col("dst").alias("src")).distinct()
        steps = settle(steps.join(ahead, ["file_id", "dst"], "left_semi").join(behind, ["file_id", "src"], "left_semi").select("file_id", "src", "dst"))
        last, n = n, steps.count()
        if n == last:
            break
    return steps


def reached(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(file_id, way, node) of all tables that the ones in ``starts`` lead to over (file_id, way, src, dst), themselves included."""
    seen = front = settle(starts)
    while True:
        ahead = front.join(steps, (front.file_id == steps.file_id) & (front.way == steps.way) & (front.node == steps.src))
        ahead = ahead.select(front.file_id, front.way, F.col("dst").alias("node")).distinct()
        front = settle(ahead.join(seen, ["file_id", "way", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(file_id, component, src, dst): the edges whose tables lead to each other, with their component's least table.

    Edges that lead nowhere or come from nowhere are taken away first. Then all parts of all files go on at once: from a part's least table the tables are
    marked that it leads to and those that lead to it; what bears both marks is a component, and what bears the same marks
    otherwise is a part of the next round.
    """
    steps = on_cycles(edges.select("file_id", "src", "dst").distinct()).withColumn("part", F.lit(""))
    out = None
    while True:
        nodes = steps.select("file_id", "part", F.explode(F.array("src", "dst")).alias("node")).distinct()
        pivots = nodes.groupBy("file_id", "part").agg(F.min("node").alias("pivot"))
        ways = steps.select("file_id", F.explode(F.array(F.struct(F.lit(True).alias("way"), "src", "dst"), F.struct(F.lit(False).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("s"))
        marks = reached(pivots.select("file_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("way"), F.col("pivot").alias("node")), settle(ways.select("file_id", "s.*")))
        marks = marks.groupBy("file_id", "node").agg(F.max(F.col("way")).alias("ahead"), F.min(F.col("way")).alias("no_back"))
        placed = nodes.join(pivots, ["file_id", "part"]).join(marks, ["file_id", "node"], "left")
        one = F.coalesce(F.col("ahead") & ~F.col("no_back"), F.lit(False))
        name = F.concat_ws("\u0001", "part", "pivot", F.coalesce(F.col("ahead").cast("string"), F.lit("none")))
        placed = placed.select("file_id", "node", one.alias("one"), F.when(one, F.col("pivot")).otherwise(name).alias("group"))
        ends = [placed.select("file_id", F.col("node").alias(end), F.struct("one", "group").alias(f"{end}_in")) for end in ("src", "dst")]
        whole = settle(steps.select("file_id", "src", "dst").join(ends[0], ["file_id", "src"]).join(ends[1], ["file_id", "dst"]).where("src_in = dst_in"))
        found = whole.where("src_in.one").select("file_id", F.col("src_in.group").alias("component"), "src", "dst")
        out = found if out is None else out.unionByName(found)
        steps = whole.where("not src_in.one").select("file_id", "src", "dst", F.col("src_in.group").alias("part"))
        if steps.isEmpty():
            return out


def foreign_key_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of (file_id, src, dst): (file_id, tables), tables the sorted names of a shortest cycle through an edge, each set once.

    Every edge on a cycle is in one that is reported; a schema's simple cycles can be exponentially many, its edges are not. Within each strongly
    connected component the shortest ways from every table spread a step a round (of equally short ones the one with the least
    names goes on), so a component of n tables and e edges makes n * e steps at most. Each round is settled in the shared folder.
    """
    steps = settle(strongly_connected(edges))
    front = settle(steps.select("file_id", "component", F.col("dst").alias("source")).distinct().withColumn("at", F.col("source")).withColumn("path", F.array("source")))
    seen = front
    while True:
        ways = front.withColumnRenamed("at", "src").join(steps, ["file_id", "component", "src"])
        ways = ways.groupBy("file_id", "component", "source", F.col("dst").alias("at")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = settle(ways.join(seen.select("file_id", "source", "at"), ["file_id", "source", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    closed = steps.select("file_id", F.col("dst").alias("source"), F.col("src").alias("at")).join(seen, ["file_id", "source", "at"])
    return closed.select("file_id", F.array_join(F.array_sort("path"), ",").alias("tables")).distinct()


def query_rules(statements: DataFrame, farthest: int = 10_000) -> DataFrame:
    """Rules on SELECT, UPDATE and DELETE statements."""
    sql, t = F.col("raw_sql"), F.col("type")
    flags = S.query_flags(sql)
    select = t == "SELECT"
    return hits(typed(statements).where(t.isin("SELECT", "INSERT", "UPDATE", "DELETE")), [
        ("PERF001", select & sql.rlike(r"(?i)\bSELECT\s+\*\s")), ("PERF002", t.isin("UPDATE", "DELETE") & ~flags["has_where"]), ("PERF003", select & ~flags["has_where"]),
        ("PERF004", sql.rlike(r"""(?i)\bLIKE\s+['"]%""")), ("PERF005", sql.rlike(r"(?i)\bORDER\s+BY\s+RANDOM\s*\(\s*\)")), ("PERF006", flags["offset"] > farthest),
        ("PERF007", select & S.has_cartesian_join(sql)), ("PERF008", S.function_in_where(sql)),
    ], "file_id", "line_no", "stmt_no")


def joins_sql(text: Column) -> Column:
    """Whether a + joins a literal that holds a word of SQL with a name in front of it or behind it. Between quotes every second piece of a line is a
    literal; one that the line doesn't close can only be joined in front."""
    pieces = F.split(text, '"')
    nth = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)), F.lit(2))
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    return F.exists(nth, lambda k: piece(k).rlike(rf"(?i)\b{SQL_WORDS}\b") & (piece(k - 1).rlike(r"\w\s*\+\s*$") | piece(k + 1).rlike(r"^\s*\+\s*\w")))


def code_rules(lines: DataFrame) -> DataFrame:
    """Rules on lines of Java that touch a database."""
    text = F.col("text")
    literal = lambda word: F.regexp_extract(text, rf'(?i)("[^"]*\b{word}\b[^"]*")', 1)
    concat = joins_sql(text) | text.rlike(r'(?i)(?:sql|query|stmt|statement)\w*\s*\+=(?:\s*[^\s";]|\s+;|\s+$)')
    return hits(lines, [
        ("APP001", text.rlike(r"\bnew\s+Statement\s*\(|\b\.createStatement\s*\(")), ("APP002", text.rlike(r"\.createStatement\s*\(\s*\)\s*\.\s*(?:execute|executeQuery|executeUpdate)\s*\(")),
        ("APP003", concat), ("APP004", text.rlike(r'(?i)"[^"]*\bSELECT\s+\*[^"]*"')),
        ("APP005", (literal("DELETE") != "") & ~literal("DELETE").contains("?")), ("APP006", (literal("UPDATE") != "") & ~literal("UPDATE").contains("?")),
    ], "file_id", "line_no")


def statement_variables(lines: DataFrame) -> DataFrame:
    """Lines that execute a variable which the file declares as a plain Statement (APP002)."""
    declared = lines.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(r"\bStatement\s+(\w+)\s*[=;]"), F.lit(1))).alias("variable")).distinct()
    called = lines.select("file_id", "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\.\s*(?:execute|executeQuery|executeUpdate)\s*\("), F.lit(1))).alias("variable"))
    return called.join(declared, ["file_id", "variable"], "left_semi").select("file_id", "line_no", "variable").distinct()


def catalog(spark: SparkSession) -> DataFrame:
    """The rules as a table."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], "rule_id string, category string, severity string, action string, policy string, text string, ord int")


def configured(violations: DataFrame, rules: DataFrame, disabled: list[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """Add category, severity and action to violations; disabled rules are dropped, severities overridden, and actions follow by each rule's policy."""
    rules = rules.where(~F.col("rule_id").isin(*disabled)) if disabled else rules
    new = F.lit(None).cast("string")
    for rule, severity in (overrides or {}).items():
        new = F.when(F.col("rule_id") == rule, severity).otherwise(new)
    migration = F.when(new == "Critical", BLOCK).when(F.col("action") == BLOCK, WARN).otherwise(F.col("action"))
    action = F.when(new.isNull() | (F.col("policy") == "keep"), F.col("action")).when(F.col("policy") == "critical", F.when(new == "Critical", BLOCK).otherwise(WARN)).otherwise(migration)
    rules = rules.withColumn("action", action).withColumn("severity", F.coalesce(new, "severity"))
    return violations.join(F.broadcast(rules.select("rule_id", "category", "severity", "action")), "rule_id")  # the registry: 46 rows


def gate(violations: DataFrame, *by: str) -> DataFrame:
    """Counts by severity and whether the gate passes; one row also without violations, or one for each of ``by``."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    blocking = F.count_if(F.col("action") == BLOCK)
    return violations.groupBy(*by).agg(F.count("*").alias("total"), count("Critical"), count("High"), count("Medium"), count("Low"), blocking.alias("blocking"), (blocking == 0).alias("passed"))


def gate_with_total(violations: DataFrame, by: str) -> DataFrame:
    """The gate of each group and, with a null group, of all: one pass by grouping sets."""
    blocking = F.count_if(F.col("action") == BLOCK)
    return violations.rollup(by).agg(F.count("*").alias("total"), blocking.alias("blocking"), (blocking == 0).alias("passed"))


def first_lines(violations: DataFrame, n: int, *by: str) -> DataFrame:
    """The first ``n`` violations of each group."""
    order = Window.partitionBy(*by).orderBy("file_id", "line_no", "rule_id")
    return violations.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
