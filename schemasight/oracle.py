"""DuckDB SQL for the queries: what each should return, written independently of Spark."""

from __future__ import annotations

from schemasight.corpus import duckdb_sql
from schemasight.registry import (
    BLOCK, BUSINESS_COLUMNS, COLLECTIONS, DDL_TYPES, INDEX_KILLERS, INDEX_LINES, NOT_COLLECTIONS, NOT_DATABASES, NOT_LITERALS, OLDER_COLLECTIONS, OLDER_FIELDS, OLDER_OPERATIONS, OPERATIONS, QUERY_FIELDS, RANGE_WORDS,
    ROLLBACK_NAMES, RULES, SKIP_COLLECTION_SUFFIXES, SKIP_COLLECTION_WORDS, SQL_WORDS, STATEMENTS, WARN,
)

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def has(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {q(regex)})"


def part(text: str, regex: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {q(regex)}, {group})"


def every(text: str, regex: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {q(regex)}, {group})"


def first_kind(text: str, patterns, flags: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {has(text, flags + p.regex)} THEN {q(p.kind)}" for p in patterns) + " END"


def add(name: str, sql: str) -> None:
    ORACLE[name] = duckdb_sql(sql)


WS = "chr(32) || chr(10) || chr(9) || chr(13)"
DOC_LINES = "doc_lines AS (SELECT doc_id AS file_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def blank(text: str, *marks: str) -> str:
    return f"(trim({text}) = ''" + "".join(f" OR starts_with(trim({text}), {q(m)})" for m in marks) + ")"


SCAN = f"scan AS (SELECT file_id, line_no, type, trim(text) AS match FROM (SELECT *, {first_kind('text', INDEX_LINES['java'], '(?i)')} AS type FROM java_lines) WHERE type IS NOT NULL AND NOT {blank('text', '//', '#')})"
add("line_scan", f"WITH {SCAN} SELECT * FROM scan")
add("context_window", f"WITH {DOC_LINES} SELECT file_id, line_no, md5(trim(array_to_string(list(text) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)), {WS})) AS context FROM doc_lines")
add("line_offsets", f"WITH {DOC_LINES} SELECT file_id, line_no, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM doc_lines")
add("comment_skip", f"SELECT file_id, count(*) AS n FROM java_lines WHERE NOT {blank('text', '//', '*')} GROUP BY file_id")
add("first_pattern_wins", f"SELECT * FROM (SELECT file_id, line_no, {first_kind('text', INDEX_LINES['java'], '(?i)')} AS type FROM java_lines) WHERE type IS NOT NULL")
add("keyword_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(role || ' ' || text), 'the')")
add("count_by_type", f"WITH {SCAN} SELECT type, count(*) AS n FROM scan GROUP BY type")
add("group_by_file", f"WITH {SCAN} SELECT file_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines FROM scan GROUP BY file_id")

KNOWN = "known AS (SELECT name, arg_max(value, seq) AS value FROM (SELECT class || '.' || field AS name, value, seq FROM constants_kv UNION ALL SELECT field, value, seq FROM constants_kv) GROUP BY name)"
add("constants_lookup", f"WITH {KNOWN} SELECT name, value FROM known")
add("resolve_constants", f"WITH {KNOWN} SELECT o.name, coalesce(k.value, o.name) AS value, count(*) AS n FROM (SELECT 'F' || CAST(o_orderkey % 30 AS VARCHAR) AS name FROM orders) o LEFT JOIN known k USING (name) GROUP BY 1, 2")

OPS = f"ops AS (SELECT file_id, line_no AS at, op FROM (SELECT *, {first_kind('text', OPERATIONS)} AS op FROM java_lines) WHERE op IS NOT NULL)"
WITH_OP = f"{OPS}, with_op AS (SELECT l.*, CASE WHEN l.line_no - o.at < 50 THEN o.op ELSE 'unknown' END AS operation FROM java_lines l ASOF LEFT JOIN ops o ON l.file_id = o.file_id AND l.line_no >= o.at)"
add("asof_operation", f"WITH {WITH_OP} SELECT file_id, line_no, operation FROM with_op")

REFS = " UNION ALL ".join(f"SELECT file_id, line_no, {k} AS k, {q(p.kind)} AS kind, strpos(text, {part('text', p.regex, 0)}) AS pos, {part('text', p.regex)} AS value FROM java_lines WHERE {has('text', p.regex)}" for k, p in enumerate(COLLECTIONS))
WITH_COLL = f"""{KNOWN}, refs AS ({REFS}), last_refs AS (
  SELECT r.file_id, r.line_no, r.pos, CASE kind WHEN 'entity' THEN lower(r.value[1]) || r.value[2:] WHEN 'constant' THEN coalesce(k.value, r.value) ELSE r.value END AS name
  FROM (SELECT * FROM refs WHERE NOT (kind = 'literal' AND (value IN {among(NOT_LITERALS)} OR length(value) < 3)) AND (kind = 'constant' OR value NOT IN {among(NOT_COLLECTIONS)}) QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY pos DESC, k) = 1) r LEFT JOIN known k ON r.kind = 'constant' AND k.name = r.value
), good_refs AS (SELECT * FROM last_refs WHERE name NOT IN {among(NOT_COLLECTIONS)}),
with_coll AS (SELECT l.file_id, l.line_no, coalesce(h.name, b.name, 'unknown') AS collection FROM java_lines l
  LEFT JOIN good_refs h ON l.file_id = h.file_id AND l.line_no = h.line_no AND h.pos = 1 ASOF LEFT JOIN good_refs b ON l.file_id = b.file_id AND l.line_no > b.line_no)"""
add("asof_collection", f"WITH {WITH_COLL} SELECT * FROM with_coll")

FOUND = " UNION ALL ".join(f"SELECT file_id, line_no, {k} AS ord, {q(p.kind)} AS kind, generate_subscripts({every('text', p.regex)}, 1) - 1 AS nth, unnest({every('text', p.regex)}) AS value FROM java_lines WHERE NOT {blank('text', '//', '*')}" for k, p in enumerate(QUERY_FIELDS))
USAGES = f"""{WITH_OP}, {WITH_COLL}, found AS ({FOUND}), usages AS (
  SELECT f.file_id, f.line_no, CAST(f.ord AS INTEGER) AS ord, CAST(f.nth AS INTEGER) AS nth, c.collection, CASE f.kind WHEN 'constant' THEN coalesce(k.value, f.value) ELSE f.value END AS field,
    CASE f.kind WHEN 'constant' THEN 'equality' ELSE f.kind END AS usage, o.operation
  FROM found f JOIN with_coll c USING (file_id, line_no) JOIN with_op o USING (file_id, line_no) LEFT JOIN known k ON f.kind = 'constant' AND k.name = f.value
  WHERE NOT starts_with(CASE f.kind WHEN 'constant' THEN coalesce(k.value, f.value) ELSE f.value END, '$') AND f.value <> '_id')"""
add("field_usages", f"WITH {USAGES} SELECT * FROM usages")


def skipped(name: str) -> str:
    return f"(coalesce({name}, '') IN ('', 'unknown') OR {has(f'lower({name})', '|'.join(SKIP_COLLECTION_WORDS))}" + "".join(f" OR ends_with(lower({name}), {q(s)})" for s in SKIP_COLLECTION_SUFFIXES) + ")"


add("collection_filter", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS name FROM documents) WHERE NOT {skipped('name')} GROUP BY doc_id")
add("db_name_validity", f"""SELECT doc_id, count(*) FILTER (WHERE length(name) BETWEEN 2 AND 64 AND name NOT IN {among(NOT_DATABASES)} AND NOT (upper(name) = name AND length(name) > 3)
  AND NOT ({has('name', '^[A-Z].*[A-Z]')} AND upper(name) <> name) AND NOT ({has('name', '^[a-z].*[A-Z]')} AND NOT {has('lower(name)', 'db|mongo')})) AS valid, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS name FROM documents) WHERE regexp_full_match(name, '[A-Za-z]+') GROUP BY doc_id""")

USABLE = f"{USAGES}, usable AS (SELECT * FROM usages WHERE NOT {skipped('collection')})"
SINGLE = f"""{USABLE}, single AS (SELECT file_id, collection, field AS fields, CASE WHEN count(*) >= 5 OR bool_or(usage = 'sort') THEN 'high' WHEN count(*) >= 2 OR bool_or(usage = 'range') THEN 'medium' ELSE 'low' END AS priority,
  count(*) AS refs, string_agg(DISTINCT operation, ', ' ORDER BY operation) AS operations,
  array_to_string(list(file_id || ':' || line_no ORDER BY line_no, ord, nth)[1:3], ', ') AS samples, 'single' AS kind, min(line_no) AS first_line FROM usable GROUP BY file_id, collection, field)"""
add("single_suggestions", f"WITH {SINGLE} SELECT * FROM single")
COMPOUND = f"""{SINGLE}, spots AS (SELECT *, floor(line_no / 10.0) * 10 AS bucket FROM usable),
firsts AS (SELECT file_id, collection, operation, bucket, field, CASE WHEN bool_or(usage = 'equality') THEN 0 WHEN bool_or(usage = 'sort') THEN 1 ELSE 2 END AS class,
  min(struct_pack(l := line_no, o := ord, n := nth)) FILTER (WHERE usage = 'equality') AS fe, min(struct_pack(l := line_no, o := ord, n := nth)) FILTER (WHERE usage = 'sort') AS fs, min(struct_pack(l := line_no, o := ord, n := nth)) FILTER (WHERE usage = 'range') AS fr
  FROM spots GROUP BY ALL HAVING true),
classed AS (SELECT *, CASE class WHEN 0 THEN fe WHEN 1 THEN fs ELSE fr END AS place FROM firsts),
buckets AS (SELECT file_id, collection, operation, bucket, list(field ORDER BY class, place) AS fields FROM classed GROUP BY ALL HAVING count(*) >= 2),
sized AS (SELECT file_id, collection, operation, bucket, count(*) AS refs, min(line_no) AS first_line FROM spots GROUP BY ALL),
compound AS (SELECT file_id, collection, array_to_string(fields[1:5], ',') AS fields, CASE WHEN len(fields) <= 3 THEN 'medium' ELSE 'high' END AS priority, refs, operation AS operations, 'compound' AS kind, first_line
  FROM buckets JOIN sized USING (file_id, collection, operation, bucket)
  QUALIFY row_number() OVER (PARTITION BY file_id, collection, list_sort(fields[1:5]) ORDER BY first_line, operation, bucket) = 1)"""
add("compound_esr", f"WITH {COMPOUND} SELECT * FROM compound")
PRUNED = f"""{COMPOUND}, covered AS (SELECT DISTINCT file_id, collection, unnest(string_split(fields, ',')) AS fields FROM compound),
pruned AS (SELECT s.* FROM single s LEFT JOIN covered c USING (file_id, collection, fields) WHERE s.priority <> 'low' OR c.file_id IS NULL)"""
add("low_subset_prune", f"WITH {PRUNED} SELECT file_id, collection, fields, priority FROM pruned")
add("suggestions_ranked", f"""WITH {PRUNED} SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, refs DESC, kind, first_line, collection, fields, operations) AS INTEGER) AS rank
  FROM (SELECT file_id, collection, fields, priority, refs, operations, kind, first_line FROM compound UNION ALL SELECT file_id, collection, fields, priority, refs, operations, kind, first_line FROM pruned)""")
add("suggestion_antijoin", f"WITH {SINGLE} SELECT file_id, collection, fields, priority FROM single WHERE NOT (collection = 'clicks' AND fields IN (SELECT 'f' || (n_nationkey % 4) FROM nation))")
add("index_dedup", "SELECT collection, index_name FROM (SELECT table_name AS collection, index_name, row_number() OVER (PARTITION BY table_name, list_sort(list_distinct(string_split(cols, ','))), seq % 2 ORDER BY seq) AS nth FROM index_defs) WHERE nth = 1")
add("usage_stats", f"WITH {USAGES} SELECT count(*) AS n, count(DISTINCT collection) AS collections, count(DISTINCT field) AS fields, count(DISTINCT file_id) AS files FROM usages")
add("legacy_suggestions", f"""WITH {USAGES} SELECT collection, field, count(*) AS refs, count(DISTINCT file_id) AS files, string_agg(DISTINCT operation, ', ' ORDER BY operation) AS operations,
  CASE WHEN count(*) >= 5 OR bool_or(operation = 'sort') THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS priority FROM usages WHERE collection <> 'unknown' GROUP BY collection, field""")

BARE = f"regexp_replace(raw_sql, {q('^(--[^' + chr(10) + ']*' + chr(10) + ')')}, '')"
TYPED = f"""kinds AS (SELECT *, CASE {' '.join(f"WHEN {has(BARE, '(?i)^' + p.regex)} THEN {q(p.kind)}" for p in STATEMENTS)} END AS kind, upper(raw_sql) AS up FROM sql_statements),
typed AS (SELECT *, CASE WHEN kind <> 'ALTER TABLE' THEN kind WHEN contains(up, 'DROP COLUMN') THEN 'DROP COLUMN' WHEN contains(up, 'ADD COLUMN') THEN 'ADD COLUMN' WHEN contains(up, 'RENAME') THEN 'ALTER TABLE RENAME'
  WHEN contains(up, 'SET DATA TYPE') OR contains(up, 'ALTER COLUMN') AND contains(up, 'TYPE') THEN 'ALTER COLUMN TYPE' ELSE 'ALTER TABLE' END AS type,
  rtrim({part('raw_sql', r'(?i)(?:DROP (?:TABLE|DATABASE)|ALTER TABLE(?: IF EXISTS)?|TRUNCATE TABLE|CREATE TABLE|INTO|^UPDATE|FROM)\s+([^\s(]+)')}, ',).;') AS target FROM kinds WHERE kind IS NOT NULL)"""
add("stmt_classify", f"WITH {TYPED} SELECT file_id, stmt_no, type FROM typed")
add("stmt_target", f"WITH {TYPED} SELECT file_id, stmt_no, target FROM typed")
add("create_index_parse", r"""WITH i AS (SELECT *, upper(raw_sql) AS up FROM sql_statements WHERE raw_sql LIKE 'CREATE INDEX%' OR raw_sql LIKE 'CREATE UNIQUE INDEX%')
SELECT file_id, stmt_no, regexp_extract(raw_sql, '(\S+) ON ', 1) AS name, regexp_extract(raw_sql, ' ON (ONLY )?([^\s(]+)', 2) AS "table",
  regexp_replace(replace(regexp_extract(raw_sql, ' ON [^(]*\(([^)]+)\)', 1), ', ', ','), ' (DESC|ASC)', '', 'g') AS columns, contains(up, 'UNIQUE') AS "unique", contains(up, 'CONCURRENTLY') AS concurrently,
  CASE WHEN contains(up, 'USING') THEN lower(regexp_extract(raw_sql, 'USING (\w+)', 1)) ELSE 'btree' END AS method, regexp_extract(raw_sql, 'INCLUDE \(([^)]+)\)', 1) AS include, regexp_extract(raw_sql, 'WHERE (.+)$', 1) AS predicate FROM i""")
DML = f"{TYPED}, dml AS (SELECT * FROM typed WHERE type IN ('SELECT', 'UPDATE', 'DELETE'))"
CLAUSES = f"""{DML}, clauses AS (SELECT file_id, stmt_no, raw_sql, {part('raw_sql', r'(?i)FROM (.+?)( WHERE| ORDER| LIMIT|$)')} AS f, {part('raw_sql', r'(?i)WHERE (.+?)( ORDER| LIMIT|$)')} AS w, {part('raw_sql', r'(?i)ORDER BY (.+?)( LIMIT|$)')} AS o FROM dml)"""
add("query_tables", f"WITH {CLAUSES} SELECT file_id, stmt_no, array_to_string(list_filter(list_transform(regexp_split_to_array(f, ' CROSS JOIN | JOIN |,'), lambda p: regexp_extract(trim(p), '^(\\w+)', 1)), lambda t: t <> ''), ',') AS names FROM clauses")
add("where_columns", f"WITH {CLAUSES} SELECT file_id, stmt_no, array_to_string({every('w', r'([a-z]\w*) (?:=|>|LIKE|NOT IN|NOT LIKE)')}, ',') AS names FROM (SELECT file_id, stmt_no, replace(w, ') =', '#=') AS w FROM clauses)")
add("join_columns", "SELECT file_id, stmt_no, CASE WHEN contains(raw_sql, ' ON t.id = u.tid') THEN 'id,tid' ELSE '' END AS names FROM (SELECT * FROM sql_statements WHERE regexp_matches(raw_sql, '^(SELECT|UPDATE|DELETE)'))")
add("orderby_columns", "WITH " + CLAUSES + r" SELECT file_id, stmt_no, array_to_string(list_filter(list_transform(string_split(regexp_replace(o, ' DESC', '', 'g'), ','), lambda p: regexp_replace(trim(p), '^.*\.', '')), lambda t: regexp_full_match(t, '\w+')), ',') AS names FROM clauses")
add("query_flags", f"WITH {DML} SELECT file_id, stmt_no, contains(up, 'WHERE') AS has_where, contains(up, 'LIMIT') AS has_limit, coalesce(TRY_CAST({part('up', 'OFFSET ([0-9]+)')} AS BIGINT), -1) AS \"offset\" FROM dml")
add("data_type_class", "SELECT data_type, count(*) AS n FROM ddl_columns GROUP BY data_type")
add("stmt_split", f"""SELECT file_id, stmt_no, {BARE} AS raw_sql,
  CAST(1 + CASE WHEN raw_sql LIKE '--%' THEN 1 ELSE 0 END + coalesce(sum(2 + length(raw_sql) - length(replace(raw_sql, chr(10), ''))) OVER (PARTITION BY file_id ORDER BY stmt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_no FROM sql_statements""")
add("create_table_parse", "SELECT table_name, ord, name, data_type, nullable, has_default FROM ddl_columns")

MIG = f"""{TYPED}, mig AS (SELECT file_id, line_no, target, unnest(list_filter([
  CASE WHEN type = 'DROP TABLE' THEN 'PG-MIG-001' WHEN type = 'DROP COLUMN' THEN 'PG-MIG-002' WHEN type = 'DROP DATABASE' THEN 'PG-MIG-003' WHEN type = 'TRUNCATE' THEN 'PG-MIG-004'
    WHEN type = 'CREATE INDEX' AND NOT contains(up, 'CONCURRENTLY') THEN 'PG-MIG-007' WHEN type = 'VACUUM' AND contains(up, 'FULL') THEN 'PG-BLK-001' WHEN type = 'CLUSTER' THEN 'PG-BLK-002'
    WHEN type = 'REINDEX' AND contains(up, 'SYSTEM') THEN 'PG-BLK-003' WHEN type = 'ALTER TYPE' THEN 'PG-BLK-004' WHEN type = 'ALTER COLUMN TYPE' THEN 'PG-BLK-005' WHEN type = 'REINDEX' THEN 'PG-BLK-006'
    WHEN type = 'ANALYZE' THEN 'PG-BLK-007' END], lambda x: x IS NOT NULL)) AS rule_id FROM typed)"""
add("mig_rules", f"WITH {MIG} SELECT * FROM mig")
DDL = f"ddl AS (SELECT file_id, arg_min(line_no, stmt_no) AS line_no, count(*) AS n_ddl FROM typed WHERE type IN {among(DDL_TYPES)} GROUP BY file_id HAVING count(*) > 1)"
add("mig_multi_ddl", f"WITH {TYPED}, {DDL} SELECT * FROM ddl")
add("mig_rollback", "SELECT dir, name FROM migration_files m WHERE NOT EXISTS (SELECT 1 FROM migration_files o WHERE o.dir = m.dir AND (" + " OR ".join(f"o.name = {q(n.split('{0}')[0])} || regexp_replace(m.name, '\\.sql$', '') || {q(n.split('{0}')[1])}" for n in ROLLBACK_NAMES) + "))")
add("mig_autofix", "SELECT file_id, stmt_no, replace(raw_sql, 'CREATE INDEX ', 'CREATE INDEX CONCURRENTLY ') AS fixed FROM sql_statements WHERE raw_sql LIKE 'CREATE INDEX %'")
add("schema_columns", f"""SELECT table_name, ord, name, unnest(list_filter([CASE WHEN data_type = 'JSON' THEN 'schema.json_instead_of_jsonb' END, CASE WHEN data_type LIKE 'TIMESTAMP WITHOUT%' THEN 'schema.timestamp_without_timezone' END,
  CASE WHEN data_type = 'SERIAL' THEN 'schema.serial_instead_of_identity' END, CASE WHEN data_type = 'NUMERIC' THEN 'schema.numeric_without_precision' END,
  CASE WHEN data_type IN ('VARCHAR(5000)', 'CHARACTER VARYING(4001)') THEN 'schema.varchar_exceeds_max_length' END, CASE WHEN nullable AND name IN {among(BUSINESS_COLUMNS)} THEN 'schema.nullable_business_column' END,
  CASE WHEN NOT nullable AND NOT has_default AND NOT is_pk AND data_type <> 'SERIAL' THEN 'schema.not_null_without_default' END], lambda x: x IS NOT NULL)) AS rule_id FROM ddl_columns""")
add("schema_keys", "SELECT * FROM (SELECT table_name, count(*) FILTER (WHERE is_pk) AS n_pk, CASE WHEN count(*) FILTER (WHERE is_pk) = 0 THEN 'schema.no_primary_key' WHEN count(*) FILTER (WHERE is_pk) > 3 THEN 'schema.composite_pk_too_wide' END AS rule_id FROM ddl_columns GROUP BY table_name) WHERE rule_id IS NOT NULL")
add("schema_missing_fk", "SELECT DISTINCT table_name, name, name[:-4] AS target FROM ddl_columns WHERE NOT is_pk AND name LIKE '%\\_id' ESCAPE '\\' AND name[:-4] <> table_name AND name[:-4] IN (SELECT table_name FROM ddl_columns)")
ORACLE["schema_fk_cycles"] = duckdb_sql(
    """SELECT DISTINCT file_id, array_to_string(list_sort(path), ',') AS tables FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id, path[1], path[-1] ORDER BY len(path), path) AS nth FROM paths /* fk_edges */ WHERE node = path[1]) WHERE nth = 1""",
    "steps AS (SELECT DISTINCT file_id, src, dst FROM fk_edges)",
    "paths AS (SELECT file_id, [src] AS path, dst AS node FROM steps UNION ALL SELECT p.file_id, list_append(p.path, p.node), s.dst FROM paths p JOIN steps s ON p.file_id = s.file_id AND p.node = s.src WHERE NOT list_contains(p.path, p.node))",
)
add("idx_fk_uncovered", "SELECT DISTINCT src AS table_name, cols AS fk_cols FROM fk_edges f WHERE NOT EXISTS (SELECT 1 FROM index_defs i WHERE i.table_name = f.src AND (i.cols = f.cols OR starts_with(i.cols, f.cols || ',')))")
add("idx_duplicates", "SELECT table_name, index_name, first_name FROM (SELECT table_name, index_name, first_value(index_name) OVER w AS first_name, row_number() OVER w AS nth FROM index_defs WINDOW w AS (PARTITION BY table_name, cols ORDER BY seq)) WHERE nth > 1")
add("idx_prefix", "SELECT DISTINCT a.table_name, a.index_name, b.index_name AS longer FROM index_defs a JOIN index_defs b ON a.table_name = b.table_name AND starts_with(b.cols, a.cols || ',')")
add("idx_prefix_classes", """WITH c AS (SELECT table_name, cols, count(DISTINCT index_name) AS members, arg_min(index_name, seq) AS index_name FROM index_defs GROUP BY 1, 2),
p AS (SELECT a.table_name, a.cols AS short, b.cols AS long, a.index_name, b.members FROM c a JOIN c b ON a.table_name = b.table_name AND starts_with(b.cols, a.cols || ','))
SELECT c.table_name, c.cols, c.index_name, c.members, (SELECT arg_max(p.index_name, length(short)) FROM p WHERE p.table_name = c.table_name AND long = c.cols) AS parent,
  coalesce(longer, 0) AS longer, CAST(coalesce(c.members * behind, 0) AS BIGINT) AS links
FROM c LEFT JOIN (SELECT table_name, short, count(*) AS longer, sum(members) AS behind FROM p GROUP BY 1, 2) u ON u.table_name = c.table_name AND u.short = c.cols""")
add("idx_prefix_pairs", "SELECT DISTINCT a.table_name, a.index_name, b.index_name AS longer FROM index_defs a JOIN index_defs b ON a.table_name = b.table_name AND starts_with(b.cols, a.cols || ',')")
add("idx_wide", "SELECT table_name, index_name, len(string_split(cols, ',')) AS n_cols FROM index_defs WHERE len(string_split(cols, ',')) > 5")
RANGE = has("c", "(?i)" + "|".join(RANGE_WORDS))
add("idx_column_order", f"""SELECT table_name, index_name, array_to_string(l, ',') AS cols, array_to_string(list_concat(list_filter(l, lambda c: NOT {RANGE}), list_filter(l, lambda c: {RANGE})), ',') AS better
  FROM (SELECT table_name, index_name, string_split(replace(replace(cols, 'c0', 'created_at'), 'c1', 'vendor'), ',') AS l FROM index_defs) WHERE l <> list_concat(list_filter(l, lambda c: NOT {RANGE}), list_filter(l, lambda c: {RANGE}))""")
add("idx_naming", "SELECT table_name, index_name FROM index_defs WHERE NOT regexp_matches(index_name, '^(?:ix_[0-9]*[05])')")
FUNCS = "|".join(INDEX_KILLERS)
PERF = f"""perf AS (SELECT file_id, line_no, stmt_no, unnest(list_filter([CASE WHEN type = 'SELECT' AND raw_sql LIKE '%SELECT * %' THEN 'PERF001' END,
  CASE WHEN type IN ('UPDATE', 'DELETE') AND NOT contains(up, 'WHERE') THEN 'PERF002' END, CASE WHEN type = 'SELECT' AND NOT contains(up, 'WHERE') THEN 'PERF003' END, CASE WHEN contains(up, 'LIKE ''%') THEN 'PERF004' END,
  CASE WHEN contains(up, 'ORDER BY RANDOM()') THEN 'PERF005' END, CASE WHEN TRY_CAST({part('up', 'OFFSET ([0-9]+)')} AS BIGINT) > 10000 THEN 'PERF006' END,
  CASE WHEN type = 'SELECT' AND contains(up, 'JOIN') AND NOT contains(up, ' ON ') THEN 'PERF007' END,
  CASE WHEN {has('up', f'WHERE.*({FUNCS})' + chr(92) + '(')} THEN 'PERF008' END], lambda x: x IS NOT NULL)) AS rule_id FROM typed WHERE type IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE'))"""
add("perf_all", f"WITH {TYPED}, {PERF} SELECT * FROM perf")
APP = f"""app AS (SELECT file_id, line_no, unnest(list_filter([CASE WHEN {has('text', r'\bnew\s+Statement\s*\(|\w\.createStatement\s*\(')} THEN 'APP001' END, CASE WHEN contains(text, 'createStatement().execute') THEN 'APP002' END,
  CASE WHEN {has('text', rf'(?i)"[^"]*\b{SQL_WORDS}\b[^"]*"\s*\+\s*\w')} OR {has('text', rf'(?i)\w+\s*\+\s*"[^"]*\b{SQL_WORDS}\b')} THEN 'APP003' END, CASE WHEN {has('text', r'(?i)"[^"]*\bSELECT\s+\*[^"]*"')} THEN 'APP004' END,
  CASE WHEN {has('text', r'"[^"?]*\bDELETE\b[^"?]*"')} THEN 'APP005' END, CASE WHEN {has('text', r'"[^"?]*\bUPDATE\b[^"?]*"')} THEN 'APP006' END], lambda x: x IS NOT NULL)) AS rule_id FROM java_lines)"""
add("app_all", f"WITH {APP} SELECT * FROM app")
add("app_stmt_vars", r"""SELECT DISTINCT c.file_id, c.line_no, c.v AS variable FROM (SELECT file_id, line_no, regexp_extract(text, '(\w+)\.(execute|executeQuery|executeUpdate)\(', 1) AS v FROM java_lines WHERE contains(text, '.execute')) c
  WHERE EXISTS (SELECT 1 FROM java_lines d WHERE d.file_id = c.file_id AND d.text LIKE 'Statement ' || c.v || ' =%')""")

ALL = f"{MIG}, {DDL}, {PERF}, {APP}, violations AS (SELECT file_id, line_no, rule_id FROM mig UNION ALL SELECT file_id, line_no, 'PG-MIG-006' FROM ddl UNION ALL SELECT file_id, line_no, rule_id FROM perf UNION ALL SELECT file_id, line_no, rule_id FROM app)"
NEW = {"PG-MIG-001": ("High", WARN), "PG-BLK-006": ("Critical", BLOCK), "APP001": ("Medium", WARN), "PERF001": ("Low", None)}


def judged(new: dict) -> str:
    rows = ", ".join(f"({q(r.id)}, {q(r.category)}, {q(new.get(r.id, (r.severity,))[0])}, {q((new.get(r.id) or (0, None))[1] or r.action)})" for r in RULES)
    return f"{ALL}, judged AS (SELECT v.*, c.category, c.severity, c.action FROM violations v JOIN (VALUES {rows}) c(rule_id, category, severity, action) USING (rule_id))"


COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = {q(s)}) AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low")) + f", count(*) FILTER (WHERE action = {q(BLOCK)}) AS blocking, count(*) FILTER (WHERE action = {q(BLOCK)}) = 0 AS passed"
add("rule_overrides", f"WITH {judged(NEW)} SELECT rule_id, severity, action, count(*) AS n FROM judged WHERE rule_id <> 'PERF003' GROUP BY 1, 2, 3")
add("violations_union", f"WITH {ALL} SELECT rule_id, count(*) AS n, count(DISTINCT file_id) AS files FROM violations GROUP BY rule_id")
add("gate", f"WITH {judged({})} SELECT {COUNTS} FROM judged")
add("gate_empty", f"WITH {judged({})} SELECT {COUNTS} FROM judged WHERE rule_id = 'none'")
add("gate_by_file", f"WITH {judged({})} SELECT file_id, {COUNTS} FROM judged GROUP BY file_id")
add("gate_with_total", f"WITH {judged({})}, s AS (SELECT *, 's' || (file_id % 7) AS service FROM judged) SELECT service, count(*) AS total, count(*) FILTER (WHERE action = {q(BLOCK)}) AS blocking, count(*) FILTER (WHERE action = {q(BLOCK)}) = 0 AS passed FROM s GROUP BY ROLLUP (service)")
add("by_category", f"WITH {judged({})} SELECT category, count(*) AS n, count(*) FILTER (WHERE severity = 'Critical') AS critical FROM judged GROUP BY category")
add("first_violations", f"WITH {judged({})} SELECT file_id, line_no, rule_id, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY file_id, line_no) AS INTEGER) AS nth FROM judged WHERE category = 'Migration Safety' QUALIFY nth <= 2")

add("catalog_filter", "SELECT service_name, namespace FROM service_catalog WHERE lower(trim(team)) = 'team nation_3'")
KINDS = "kinds AS (SELECT * REPLACE (trim(team) AS team), contains(db_service, 'PostgreSQL') AS has_postgres, contains(db_service, 'MongoDB') AS has_mongodb, uri_location <> 'Service not found' AS has_path, db_service NOT IN ('', 'none') AS supported FROM service_catalog)"
add("catalog_kinds", f"WITH {KINDS} SELECT team, has_postgres, has_mongodb, has_path, supported, count(*) AS n FROM kinds GROUP BY ALL")
add("distinct_teams", "SELECT DISTINCT trim(team) AS team FROM service_catalog WHERE trim(team) <> ''")
add("team_rollup", f"WITH {KINDS} SELECT team, count(*) AS services, count(*) FILTER (WHERE has_path AND supported) AS scanned, count(*) FILTER (WHERE NOT (has_path AND supported)) AS skipped, count(*) FILTER (WHERE has_path AND supported AND has_postgres) AS postgres FROM kinds GROUP BY team")
URIS = r"""uris AS (SELECT service, key, seq, value, CASE WHEN contains(value, 'postgres') THEN 'postgresql' WHEN contains(value, 'mongodb') THEN 'mongodb' END AS kind,
  CASE WHEN contains(value, '://') AND NOT contains(value, 'redis') THEN regexp_extract(value, '(?:@|://)([hm][0-9]+)', 1) END AS host,
  CASE WHEN contains(value, 'postgres') THEN coalesce(TRY_CAST(regexp_extract(value, ':([0-9]+)/', 1) AS INTEGER), 5432) WHEN contains(value, 'mongodb') THEN coalesce(TRY_CAST(regexp_extract(value, ':([0-9]+)/', 1) AS INTEGER), 27017) END AS port,
  CASE WHEN contains(value, '://') AND NOT contains(value, 'redis') THEN regexp_extract(value, '[^/]/(\w+)', 1) END AS name FROM env_vars)"""
add("uri_parse", f"WITH {URIS} SELECT service, key, kind, host, coalesce(port, 0) AS port, name FROM uris")
add("db_connections", f"WITH {URIS} SELECT service, value, kind, host, port, name, arg_min(key, seq) AS key FROM uris WHERE kind IS NOT NULL GROUP BY ALL")
add("unused_indexes", "SELECT index_name, table_name, CAST(coalesce(size_bytes, 0) AS BIGINT) AS size_bytes, 'PG_IDX_014' AS rule_id FROM live_catalog WHERE idx_scan = 0")
add("index_sizes", "SELECT index_name, table_name, size_bytes FROM live_catalog WHERE size_bytes IS NOT NULL")
add("plan_metrics", f"SELECT query_id, CAST(len({every('plan_text', 'Seq Scan', 0)}) AS BIGINT) AS seq_scans, CAST(len({every('plan_text', 'Index Scan', 0)}) AS BIGINT) AS index_scans, TRY_CAST({part('plan_text', 'rows=([0-9]+)')} AS BIGINT) AS rows, TRY_CAST({part('plan_text', 'Time: ([0-9.]+)')} AS DOUBLE) AS ms FROM plans")
YAML = "y AS (SELECT 'svc' || c_custkey AS service, c_custkey AS k, c_nationkey AS nation, c_mktsegment AS seg FROM customer WHERE c_custkey % 9 < 7)"
add("flattened_settings", f"""WITH {YAML} SELECT service, unnest(['env.db_url', 'db_url', 'db.port', 'port']) AS key, unnest(['jdbc:postgresql://h' || nation || '/db', 'jdbc:postgresql://h' || nation || '/db', CAST(5000 + k AS VARCHAR), CAST(5000 + k AS VARCHAR)]) AS value FROM y
UNION ALL SELECT service, 'db.host', CASE WHEN k % 2 = 0 THEN 'later' ELSE 'h ' || seg END FROM y UNION ALL SELECT service, 'host', CASE WHEN k % 2 = 0 THEN 'later' WHEN k % 3 = 0 THEN 'inner' ELSE 'h ' || seg END FROM y
UNION ALL SELECT service, unnest(['pools.main.host', 'pools.main.size', 'size']), unnest(['inner', '7', '7']) FROM y WHERE k % 3 = 0""")
ENDS = "regexp_replace(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g')"
add("text_lines", f"WITH te AS (SELECT doc_id, {ENDS} AS t FROM mixed_ends), tl AS (SELECT doc_id, CASE WHEN t = '' THEN '' WHEN t[-1] = chr(10) THEN t[:-2] ELSE t END AS body, t FROM te) "
    "SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS INT) AS n_lines, md5(replace(body, chr(10), '|')) AS lines FROM tl")
DIRS = "string_split(path, '/')[:-2]"
LEFT_OUT = "['.git', 'node_modules', '__pycache__', '.idea', '.vscode', 'target', 'build', 'dist', '.gradle', 'venv', '.env'"
add("path_parts", f"SELECT path, name, regexp_replace(name, '[.][^.]*$', '') AS stem, lower(coalesce('.' || nullif(split_part(name, '.', 2), ''), '')) AS extension, replace(path, '/', '_') AS safe, "
    f"list_has_any(dirs, {LEFT_OUT}, 'test', 'tests', 'testFixtures']) AS skipped, list_has_any(dirs, {LEFT_OUT}]) AS skipped_as_project FROM (SELECT path, string_split(path, '/')[-1] AS name, {DIRS} AS dirs FROM project_files)")
ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
add("escaped_pages", f"SELECT page_id, length({ESCAPED}) AS n, md5({ESCAPED}) AS escaped FROM pages")
add("table_lines", "SELECT doc_id, rtrim(" + " || '  ' || ".join(f"rpad(left(translate(coalesce(CAST({c} AS VARCHAR), ''), chr(10) || chr(13) || chr(9), '   '), {w}), {w}, ' ')" for c, w in (("doc_id", 8), ("source", 12), ("text", 40))) + ", ' ') AS table_line FROM documents")
# nodes from the arrows, parents by a lateral look back, depths and subtrees by the closure of parents
PLAN_NODES = r"""pl AS (SELECT query_id, i, l[i] AS line FROM (SELECT query_id, string_split(plan_text, chr(10)) AS l, unnest(range(1, len(string_split(plan_text, chr(10))) + 1)) AS i FROM plan_trees)),
pn AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INT) AS node, CASE WHEN i = 1 THEN -1 ELSE instr(line, '->') END AS ind, trim(replace(split_part(line, '  (cost', 1), '->', '')) AS operation,
  TRY_CAST(regexp_extract(line, 'cost=\S+ rows=(\d+)', 1) AS BIGINT) AS estimated, TRY_CAST(regexp_extract(line, 'time=\S+ rows=(\d+)', 1) AS BIGINT) AS r,
  TRY_CAST(regexp_extract(line, 'time=[0-9.]+?[.][.](\S+) ', 1) AS DECIMAL(18, 3)) AS t, TRY_CAST(regexp_extract(line, 'loops=(\d+)', 1) AS BIGINT) AS loops FROM pl WHERE i = 1 OR starts_with(trim(line), '->')),
pp AS (SELECT a.query_id, a.node, max(b.node) AS parent FROM pn a LEFT JOIN pn b ON a.query_id = b.query_id AND b.node < a.node AND b.ind < a.ind GROUP BY a.query_id, a.node),
up AS (SELECT query_id, node, node AS over FROM pn UNION ALL SELECT up.query_id, up.node, pp.parent FROM up JOIN pp ON up.query_id = pp.query_id AND up.over = pp.node WHERE pp.parent IS NOT NULL),
pd AS (SELECT query_id, node, CAST(count(*) - 1 AS INT) AS depth FROM up GROUP BY query_id, node),
ps AS (SELECT up.query_id, up.over AS node, count(*) AS subtree_nodes, CAST(sum(coalesce(r * loops, 0)) AS BIGINT) AS subtree_rows FROM up JOIN pn ON up.query_id = pn.query_id AND up.node = pn.node GROUP BY up.query_id, up.over),
pc AS (SELECT pp.query_id, pp.parent AS node, sum(coalesce(t * loops, 0)) AS inner_ms FROM pp JOIN pn ON pp.query_id = pn.query_id AND pp.node = pn.node GROUP BY pp.query_id, pp.parent),
plan_rows AS (SELECT pn.query_id, pn.node, parent, depth, operation, estimated, r * loops AS rows, CAST(t * loops AS DOUBLE) AS ms, CAST(t * loops - coalesce(inner_ms, 0) AS DOUBLE) AS own_ms, subtree_nodes, subtree_rows
  FROM pn JOIN pp USING (query_id, node) JOIN pd USING (query_id, node) JOIN ps USING (query_id, node) LEFT JOIN pc USING (query_id, node))"""
add("plan_nodes", f"WITH {PLAN_NODES} SELECT * FROM plan_rows")
add("slowest_nodes", f"WITH {PLAN_NODES} SELECT query_id, node, operation, own_ms, CASE WHEN whole > 0 THEN round(own_ms / whole, 6) END AS share FROM (SELECT *, max(CASE WHEN node = 1 THEN ms END) OVER (PARTITION BY query_id) AS whole FROM plan_rows WHERE own_ms IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY own_ms DESC, node) = 1")

KEYED = "keyed AS (SELECT table_name AS collection, cols AS fields, index_name, seq, array_to_string(list_sort(list_distinct(string_split(cols, ','))), ',') AS key FROM index_defs)"
add("script_compare", f"WITH {KEYED} SELECT collection, key, CASE WHEN bool_or(seq % 3 < 2) AND bool_or(seq % 3 > 0) THEN 'both' WHEN bool_or(seq % 3 < 2) THEN 'script_only' ELSE 'code_only' END AS status FROM keyed GROUP BY collection, key")
add("code_union", f"WITH {KEYED}, r AS (SELECT *, 0 AS p FROM keyed WHERE seq % 3 < 2 UNION ALL SELECT *, 1 FROM keyed WHERE seq % 3 > 0) SELECT collection, key, arg_max(fields, struct_pack(p := p, f := fields)) AS fields, max(p) AS suggested FROM r GROUP BY collection, key")
LIVE = """live AS (SELECT DISTINCT 't' || (p_partkey % 50) AS table_name, list_sort(list_distinct(list_transform([p_size, length(p_name), p_partkey, length(p_type)], lambda n: 'c' || (n % 4)))) AS have FROM part),
wanted AS (SELECT seq AS id, table_name, list_distinct(string_split(cols, ',')) AS want FROM index_defs)"""
add("pg_coverage", f"WITH {LIVE} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.table_name = w.table_name AND list_has_all(l.have, w.want)) THEN 'exists' ELSE 'missing' END AS status FROM wanted w")
add("doc_coverage", f"WITH {LIVE} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.table_name = w.table_name AND list_has_all(l.have[1:len(w.want) + 2], w.want)) THEN 'exists' ELSE 'missing' END AS status FROM wanted w")
add("tenant_expansion", "WITH l AS (SELECT DISTINCT (c_custkey % 50) || CASE c_custkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END || lower(n_name) AS live FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT DISTINCT lower(n_name) AS name FROM nation) SELECT DISTINCT name, live FROM n, l WHERE live = name OR ends_with(live, '_' || name) OR ends_with(live, '-' || name)")
add("compare_eligibility", "WITH s AS (SELECT table_name AS collection, count(*) AS n FROM index_defs GROUP BY table_name), z AS (SELECT 't' || (p_partkey % 45) AS collection, count(*) FILTER (WHERE p_size > 20) AS docs FROM part GROUP BY 1) SELECT s.*, CASE WHEN docs IS NULL THEN 'collection_not_found' WHEN docs < 50 THEN 'small_collection' ELSE 'eligible' END AS status FROM s LEFT JOIN z USING (collection)")
add("esr_analysis", """WITH u AS (SELECT table_name AS collection, 'c' || (seq % 3) AS field, bool_or(seq % 7 = 0) AS s, bool_or(seq % 7 > 0 AND seq % 5 = 0) AS r FROM index_defs GROUP BY 1, 2),
f AS (SELECT table_name AS collection, index_name, generate_subscripts(l, 1) AS pos, unnest(l) AS field FROM (SELECT *, string_split(cols, ',') AS l FROM index_defs) WHERE len(l) > 1),
c AS (SELECT f.*, CASE WHEN s THEN 'S' WHEN r THEN 'R' WHEN s IS NULL THEN '?' ELSE 'E' END AS c FROM f LEFT JOIN u USING (collection, field))
SELECT collection, index_name, string_agg(c, '' ORDER BY pos) AS classes, regexp_full_match(replace(string_agg(c, '' ORDER BY pos), '?', ''), 'E*S*R*') AS compliant, string_agg(field, ',' ORDER BY strpos('ESR?', c), pos) AS better FROM c GROUP BY collection, index_name""")
add("create_plan", "SELECT lower(r_name) AS database, table_name, index_name FROM region, index_defs")

SPECS = "specs AS (SELECT table_name AS collection, index_name, seq % 4 = 0 AS uniq, list_distinct(string_split(cols, ',')) AS l0, string_split(cols, ',') AS raw FROM index_defs), ordered AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS l FROM specs)"


def listed(expr: str, sep: str = ", ") -> str:
    return f"array_to_string(list_transform(l, lambda c: {expr}), {q(sep)})"


DIR = "CASE WHEN c = 'c3' THEN '-1' ELSE '1' END"
SHELL_KEYS = listed("""'"' || c || '": ' || """ + DIR)
SHELL = "'db.' || collection || '.createIndex({ ' || " + SHELL_KEYS + " || ' }' || CASE WHEN uniq THEN ', { unique: true }' ELSE '' END || ');'"
PG_COLS = listed("c || CASE WHEN c = 'c3' THEN ' DESC' ELSE '' END")
add("mongo_shell_lines", f"WITH {SPECS} SELECT collection, index_name, {SHELL} AS line FROM ordered")
PY_KEYS = listed("""'("' || c || '", ' || CASE WHEN c = 'c3' THEN 'DESCENDING' ELSE 'ASCENDING' END || ')'""")
add("pymongo_lines", f"""WITH {SPECS} SELECT collection, index_name, 'db["' || collection || '"].create_index([' || {PY_KEYS} || ']' || CASE WHEN uniq THEN ', unique=True' ELSE '' END || ')' AS line FROM ordered""")
add("pg_ddl_lines", f"WITH {SPECS} SELECT collection, index_name, CASE WHEN uniq THEN 'CREATE UNIQUE INDEX' ELSE 'CREATE INDEX' END || ' CONCURRENTLY IF NOT EXISTS ' || left('idx_' || collection || '_' || {listed('c', '_')}, 63) || ' ON public.' || collection || ' (' || {PG_COLS} || ');' AS line FROM ordered")
VERIFY_KEY = listed("c || '_' || " + DIR, "_")
add("verify_lines", f"WITH {SPECS}, k AS (SELECT DISTINCT collection, {VERIFY_KEY} AS key FROM ordered) SELECT collection, count(*) AS n, string_agg(key, ';' ORDER BY key) AS expected FROM k GROUP BY collection")
PAIRS = listed("c || ':' || " + DIR, ",")
add("pg_indexdef_parse", f"WITH {SPECS} SELECT index_name, {PAIRS} AS columns FROM ordered")
add("script_parse", f"WITH {SPECS} SELECT collection, index_name, {PAIRS} AS fields, uniq AS \"unique\" FROM ordered")

# What the corpora below hold is known from the rows that they are made of, so these say it without reading any text.
add("script_usages", """WITH s AS (SELECT *, last_value(CASE WHEN k % 6 = 0 THEN 'c' || (k % 4) END IGNORE NULLS) OVER w AS coll FROM script_lines WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ops AS (SELECT file_id, line_no AS at, CASE k % 6 WHEN 3 THEN 'update' ELSE 'find' END AS op FROM script_lines WHERE k % 6 IN (1, 2, 3))
SELECT s.file_id, s.line_no, 0 AS ord, 0 AS nth, CASE k % 6 WHEN 1 THEN 'a' || (k % 5) WHEN 3 THEN 'b' ELSE 'd' END AS field, 'filter' AS usage, CASE WHEN s.line_no - o.at < 50 THEN o.op ELSE 'unknown' END AS operation,
  coalesce(coll, 'unknown') AS collection, CASE WHEN coll IS NULL THEN 'unknown' ELSE 'direct' END AS collection_type
FROM s ASOF LEFT JOIN ops o ON s.file_id = o.file_id AND s.line_no >= o.at WHERE k % 6 IN (1, 3, 5)""")
OLD_OPS = f"ops AS (SELECT file_id, line_no AS at, op FROM (SELECT *, {first_kind('text', OLDER_OPERATIONS)} AS op FROM java_lines) WHERE op IS NOT NULL)"
OLD_REFS = " UNION ALL ".join(f"SELECT file_id, line_no, {k} AS k, {q(p.kind)} AS kind, strpos(text, {part('text', p.regex, 0)}) AS pos, {part('text', p.regex)} AS value FROM java_lines WHERE {has('text', p.regex)}" for k, p in enumerate(OLDER_COLLECTIONS))
OLD_FOUND = " UNION ALL ".join(f"SELECT file_id, line_no, {k} AS ord, {q(p.kind)} AS usage, generate_subscripts({every('text', p.regex)}, 1) - 1 AS nth, unnest({every('text', p.regex)}) AS field FROM java_lines WHERE NOT {blank('text', '//', '#', '*')}" for k, p in enumerate(OLDER_FIELDS))
add("older_findings", f"""WITH {OLD_OPS}, refs AS ({OLD_REFS}), last_refs AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY pos DESC, k) = 1), found AS ({OLD_FOUND})
SELECT f.file_id, f.line_no, CAST(f.ord AS INTEGER) AS ord, CAST(f.nth AS INTEGER) AS nth, f.field, f.usage, CASE WHEN f.line_no - o.at < 50 THEN o.op ELSE 'unknown' END AS operation,
  coalesce(h.value, b.value, 'unknown') AS collection, coalesce(h.kind, b.kind, 'unknown') AS collection_type
FROM found f LEFT JOIN last_refs h ON h.file_id = f.file_id AND h.line_no = f.line_no AND h.pos = 1
  ASOF LEFT JOIN ops o ON f.file_id = o.file_id AND f.line_no >= o.at ASOF LEFT JOIN last_refs b ON f.file_id = b.file_id AND f.line_no > b.line_no WHERE f.field <> '_id' AND NOT starts_with(f.field, '$')""")
add("collection_whole_file", f"WITH {WITH_COLL} SELECT * FROM with_coll")
add("declared_indexes", """WITH d AS (SELECT *, 'c' || (n % 7) AS collection FROM java_classes)
SELECT collection, 'compound' AS kind, 'a:1,b:-1' AS fields, 'ab' AS name, true AS "unique", false AS sparse, CAST(NULL AS INTEGER) AS ttl, path FROM d WHERE z % 3 = 0
UNION ALL SELECT collection, 'compound', 's:1', NULL, false, false, NULL, path FROM d WHERE z % 4 = 0
UNION ALL SELECT collection, 'single', 'f' || z || ':1', NULL, true, false, 60, path FROM d WHERE z % 5 <> 0""")
add("special_indexes", """SELECT 'k' || (n % 5) AS collection, ['text', 'geo', 'hashed', 'wildcard'][z % 4 + 1] AS kind, 'F' || z || ':' || ['text', '1', 'hashed', '1'][z % 4 + 1] AS fields, CAST(NULL AS VARCHAR) AS name,
  false AS "unique", false AS sparse, CAST(NULL AS INTEGER) AS ttl, path FROM annotated_classes""")
add("resolved_compounds", f"""WITH {KNOWN} SELECT path, 'k' || (n % 5) AS collection, coalesce(k.value, 'F' || (n % 40)) || ':1,plain:-1' AS fields, 'by(f' AS name, true AS sparse FROM annotated_classes LEFT JOIN known k ON k.name = 'F' || (n % 40)
UNION ALL SELECT path, 'k' || (n % 5), 'bad:-1', NULL, false FROM annotated_classes WHERE z % 3 > 0""")
add("annotation_errors", """SELECT path, path || ':4: @CompoundIndex: direction 2 of field bad' AS error FROM annotated_classes WHERE z % 3 = 0
UNION ALL SELECT path, path || ':' || CASE WHEN z % 4 = 3 THEN 8 ELSE 7 END || ': @Indexed: its brackets do not close' FROM annotated_classes WHERE z % 5 = 0""")
add("table_constraints", """SELECT n, CAST(pos AS INTEGER) AS pos, name, kind, columns, target, target_columns, expression, inline FROM (
  SELECT n, 0 AS pos, NULL AS name, 'PRIMARY KEY' AS kind, 'id' AS columns, NULL AS target, '' AS target_columns, NULL AS expression, true AS inline FROM table_scripts WHERE n % 2 = 0
  UNION ALL SELECT n, 1, 'in range', 'CHECK', 'a', NULL, '', 'a > 0 AND (a < 9 OR b = '')'')', true FROM table_scripts
  UNION ALL SELECT n, 2, NULL, 'FOREIGN KEY', 'b', 'other', 'k', NULL, true FROM table_scripts
  UNION ALL SELECT o_orderkey, 3, CASE o_orderkey % 3 WHEN 0 THEN 'Fk' END, 'FOREIGN KEY', CASE o_orderkey % 3 WHEN 0 THEN 'a,B c' ELSE 'c' || (o_custkey % 9) END, CASE o_orderkey % 3 WHEN 0 THEN 'Target t' ELSE 't' || (o_custkey % 7) END, CASE o_orderkey % 3 WHEN 0 THEN 'x,y' ELSE '' END, NULL, false FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 4 ELSE 3 END, CASE o_orderkey % 5 WHEN 0 THEN 'u' END, ['UNIQUE', 'UNIQUE', 'CHECK', 'EXCLUDE'][o_orderkey % 5 + 1], ['a,b', 'b', '', ''][o_orderkey % 5 + 1], NULL, '', CASE o_orderkey % 5 WHEN 2 THEN 'a <> ' || o_custkey WHEN 3 THEN 'a WITH =' END, false FROM orders WHERE o_orderkey % 5 < 4
  UNION ALL SELECT n, CASE WHEN n % 3 < 2 THEN 5 ELSE 4 END, 'pk', 'PRIMARY KEY', 'id,a', NULL, '', NULL, false FROM table_scripts WHERE n % 2 = 1)""")
add("standalone_compound", """SELECT path, CAST(strpos(content, '@CompoundIndex(def = "{''s') - 1 AS INTEGER) AS start FROM java_classes WHERE z % 4 = 0""")
add("forward_field", "SELECT path, 0 AS nth, CASE WHEN z % 5 <> 0 THEN 'f' || z END AS field FROM java_classes")
add("discover_by_category", "SELECT path, CASE WHEN z % 8 < 4 THEN 'java' WHEN z % 8 = 4 THEN 'python' WHEN z % 8 = 5 THEN 'javascript' ELSE 'config' END AS category FROM project_files WHERE z % 8 < 6 OR z % 8 = 7 AND n % 2 = 0")
add("non_query_filter", "SELECT path FROM project_files WHERE z % 8 = 0")
add("config_db_names", """SELECT CASE n % 4 WHEN 0 THEN lower(replace(n_name, ' ', '_')) WHEN 1 THEN 'e' || n ELSE 'j' || n END AS name, path FROM setting_files JOIN nation ON n = n_nationkey WHERE n % 4 < 3
UNION ALL SELECT value, NULL FROM constants_kv WHERE seq % 4 <> 0""")
add("deployed_db_names", "SELECT 'd' || n AS name, path FROM deploy_files WHERE n % 4 = 0 UNION ALL SELECT 'u' || n, path FROM deploy_files WHERE n % 4 = 0 UNION ALL SELECT 'inc' || n, path FROM deploy_files WHERE n % 4 = 1")
add("primary_db_fill", "SELECT table_name, index_name, CASE WHEN seq % 3 = 0 THEN 'own' ELSE (SELECT lower(replace(n_name, ' ', '_')) FROM nation WHERE n_nationkey = 0) END AS database FROM index_defs")
add("values_of_catalog", "SELECT c_name AS service, 'svc' || (c_custkey % 40) || '/values.yaml' AS path FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 40 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)")
add("values_discovered", "SELECT split_part(path, '/', 1) AS service, path FROM values_paths WHERE contains(path, 'values')")
add("connection_keys", "SELECT ['Spring.Data-MongoDB.uri', 'DATABASE_URL', 'db-host', 'MONGO.DATABASE', 'other'][c_custkey % 5 + 1] AS key, ['mongodb', 'postgresql', 'host', 'name', NULL][c_custkey % 5 + 1] AS kind, count(*) AS n FROM customer GROUP BY 1, 2")
add("name_antijoin", "SELECT table_name, 'n' || (seq % 97) AS index_name, min(seq) AS seq FROM index_defs GROUP BY 1, 2")
add("catalog_by_namespace", "SELECT service_name FROM service_catalog WHERE namespace = 'EUROPE' AND sub_team = 'sub'")
add("services_violations", f"WITH {judged({})} SELECT s.service_name, count(*) AS n FROM judged JOIN service_catalog s ON file_id = c_custkey WHERE s.uri_location <> 'Service not found' GROUP BY 1")
add("status_counts", 'SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS created, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS "exists", count(*) FILTER (WHERE o_orderkey % 3 = 2) AS error FROM orders')
add("compare_summary", f"""WITH {KEYED}, c AS (SELECT collection, key, bool_or(seq % 3 < 2) AS s, bool_or(seq % 3 > 0) AS d FROM keyed GROUP BY ALL)
SELECT count(*) FILTER (WHERE s) AS script_total, count(*) FILTER (WHERE d) AS code_total, count(*) FILTER (WHERE s AND d) AS covered, count(*) FILTER (WHERE NOT d) AS extra_in_script, count(*) FILTER (WHERE NOT s) AS missing_from_script FROM c""")
add("default_index_skip", "SELECT p_partkey, '_id:1,a:1' AS fields, 'shop' AS database FROM part WHERE p_size % 3 <> 0 AND p_partkey % 4 <> 0")
add("top_suggestions", f"""WITH {USAGES}, s AS (SELECT collection, field, count(*) AS refs, count(DISTINCT file_id) AS files, string_agg(DISTINCT operation, ', ' ORDER BY operation) AS operations,
  CASE WHEN count(*) >= 5 OR bool_or(operation = 'sort') THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS priority FROM usages WHERE collection <> 'unknown' GROUP BY collection, field)
SELECT * FROM s ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, refs DESC, collection, field LIMIT 10""")
add("line_report", f"WITH {SCAN} SELECT 'by_type' AS section, type AS name, count(*) AS n FROM scan GROUP BY type UNION ALL SELECT 'by_file', CAST(file_id AS VARCHAR), count(*) FROM scan GROUP BY file_id UNION ALL SELECT 'all', 'lines', count(*) FROM scan")
add("scan_summary", f"""WITH {PRUNED}, s AS (SELECT priority FROM compound UNION ALL SELECT priority FROM pruned), i AS (SELECT 'compound' AS kind FROM java_classes WHERE z % 3 = 0 UNION ALL SELECT 'compound' FROM java_classes WHERE z % 4 = 0 UNION ALL SELECT 'single' FROM java_classes WHERE z % 5 <> 0)
SELECT 'total' AS section, 'indexes' AS name, count(*) AS n FROM i UNION ALL SELECT 'total', 'suggestions', count(*) FROM s UNION ALL SELECT 'by_type', kind, count(*) FROM i GROUP BY kind UNION ALL SELECT 'by_priority', priority, count(*) FROM s GROUP BY priority""")
add("json_report", f"""WITH {judged({})} SELECT 'violations' AS section, rule_id AS value, count(*) AS n FROM judged GROUP BY rule_id UNION ALL SELECT 'gate_decision', CAST(count(*) AS VARCHAR), 1 FROM judged
UNION ALL SELECT 'summary', CAST(count(*) FILTER (WHERE z % 8 < 4) AS VARCHAR), 1 FROM project_files UNION ALL SELECT 'errors', NULL, count(*) FROM orders HAVING count(*) > 0""")
add("first_errors", "SELECT project, error, nth, greatest(0, all_ - 5) AS more FROM (SELECT o_custkey % 10 AS project, 'e' || o_orderkey AS error, CAST(row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY 'e' || o_orderkey) AS INTEGER) AS nth, count(*) OVER (PARTITION BY o_custkey % 10) AS all_ FROM orders) WHERE nth <= 5")
add("esr_recommendation", """WITH u AS (SELECT table_name AS collection, 'c' || (seq % 3) AS field, bool_or(seq % 7 = 0) AS s, bool_or(seq % 7 > 0 AND seq % 5 = 0) AS r FROM index_defs GROUP BY 1, 2),
f AS (SELECT table_name AS collection, index_name, generate_subscripts(l, 1) AS pos, unnest(l) AS field FROM (SELECT *, string_split(cols, ',') AS l FROM index_defs) WHERE len(l) > 1),
c AS (SELECT f.*, CASE WHEN s THEN 'S' WHEN r THEN 'R' WHEN s IS NULL THEN '?' ELSE 'E' END AS c FROM f LEFT JOIN u USING (collection, field))
SELECT collection, index_name, CASE WHEN NOT regexp_full_match(replace(string_agg(c, '' ORDER BY pos), '?', ''), 'E*S*R*') THEN 'Reorder to ESR: ' || string_agg(field || '(' || c || ')', ' → ' ORDER BY strpos('ESR?', c), pos) END AS advice FROM c GROUP BY collection, index_name""")
SCRIPTED = """scripted AS (SELECT CASE WHEN seq % 3 > 0 THEN 'db' || (seq % 3) ELSE 'unknown' END AS database, table_name AS collection, seq, list_filter(string_split(cols, ','), lambda x, i: list_position(string_split(cols, ','), x) = i) AS l,
  list_filter([CASE WHEN seq % 4 = 0 THEN 'unique' END, CASE WHEN seq % 5 = 0 THEN 'sparse' END], lambda x: x IS NOT NULL) AS o, CASE WHEN seq % 6 = 0 THEN seq % 100 END AS ttl FROM index_defs)"""
SHELL_LINE = "'db.' || collection || '.createIndex({' || " + listed("""'"' || c || '": ' || CASE c WHEN 'c3' THEN '-1' WHEN 'c2' THEN '"text"' ELSE '1' END""") + """ || '}' || CASE WHEN len(o) > 0 OR ttl IS NOT NULL THEN ', {' || array_to_string(list_concat(list_transform(o, lambda x: '"' || x || '": true'), CASE WHEN ttl IS NULL THEN [] ELSE ['"expireAfterSeconds": ' || ttl] END), ', ') || '}' ELSE '' END || ');'"""
add("mongo_script", f"""WITH {SCRIPTED}, d AS (SELECT DISTINCT database FROM scripted), g AS (SELECT DISTINCT database, collection FROM scripted)
SELECT database, collection, 5 AS part, seq, {SHELL_LINE} AS line FROM scripted
UNION ALL SELECT NULL, NULL, CAST(k AS INTEGER), 0, ['// Auto-generated MongoDB index creation script', '// Generated from source code analysis', ''][k + 1] FROM range(3) t(k)
UNION ALL SELECT database, NULL, 1, 0, '// Database: ' || database FROM d UNION ALL SELECT database, NULL, 2, 0, 'use ' || database || ';' FROM d UNION ALL SELECT database, NULL, 3, 0, '' FROM d
UNION ALL SELECT database, collection, 4, 0, '// Collection: ' || collection FROM g UNION ALL SELECT database, collection, 6, 0, '' FROM g""")
PY_LINE = """'db["' || collection || '"].create_index([' || """ + listed("""'("' || c || '", ' || CASE c WHEN 'c3' THEN 'DESCENDING' WHEN 'c2' THEN 'TEXT' ELSE 'ASCENDING' END || ')'""") + """ || ']' || CASE WHEN len(o) > 0 OR ttl IS NOT NULL THEN ', ' || array_to_string(list_concat(list_transform(o, lambda x: x || '=True'), CASE WHEN ttl IS NULL THEN [] ELSE ['expireAfterSeconds=' || ttl] END), ', ') ELSE '' END || ')'"""
PY_HEAD = ["#!/usr/bin/env python3", '"""Auto-generated pymongo index creation script."""', "", "from pymongo import MongoClient, ASCENDING, DESCENDING, TEXT", "", 'client = MongoClient("mongodb://localhost:27017")', 'db = client["mydb"]', ""]
add("pymongo_script", f"""WITH {SCRIPTED}, g AS (SELECT DISTINCT collection FROM scripted)
SELECT collection, 5 AS part, seq, {PY_LINE} AS line FROM scripted
UNION ALL SELECT NULL, 0, k, [{', '.join(map(q, PY_HEAD))}][k + 1] FROM range(8) t(k)
UNION ALL SELECT collection, 4, 0, '# Collection: ' || collection FROM g UNION ALL SELECT collection, 6, 0, '' FROM g""")
add("shell_keys", "SELECT p_partkey, 'a' || p_partkey || ':1,b:-1,c:text' AS fields FROM part")
add("pymongo_keys", "SELECT p_partkey, 'a' || p_partkey || ':1,b:-1,c:text,d:hashed' AS fields FROM part")
add("script_calls", """SELECT file_id, 0 AS ord, 0 AS nth, 't1' AS collection, 'a' || file_id || ':1,c:text' AS fields, 'db.t1.createIndex({a' || file_id || ': 1, c: "text"}' AS raw FROM index_scripts
UNION ALL SELECT file_id, 1, 0, 't2', 'b:-1,h:hashed', 'db["t2"].create_index([("b", DESCENDING), (''h'', HASHED)]' FROM index_scripts
UNION ALL SELECT file_id, 2, 0, 't1', 'a' || file_id || ':1,c:text', 't1.createIndex({a' || file_id || ': 1, c: "text"}' FROM index_scripts
UNION ALL SELECT file_id, 2, 2, 'users', 'y:-1', 'users.createIndex({"y": -1}' FROM index_scripts""")
