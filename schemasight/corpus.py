"""Corpora derived from the driver's tables: the tables hold no source code, so SQL projections make lines of code,
statements, index definitions and catalogs of them. The text of most is read by Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

CORPORA = {
    "java_lines": """
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS INT) AS line_no, text FROM (SELECT user_id AS file_id, ts, event_id, CASE k % 18
  WHEN 0 THEN 'MongoCollection coll = db.getCollection("' || event_type || 's");'
  WHEN 1 THEN 'cursor = coll.find(new BasicDBObject("f' || CAST(user_id % 7 AS STRING) || '", value));'
  WHEN 2 THEN 'q.append("g' || CAST(k % 5 AS STRING) || '", x);'
  WHEN 3 THEN 'coll.find(Filters.gt("amount", 5));'
  WHEN 4 THEN 'cursor.sort(new BasicDBObject("ts", -1));'
  WHEN 5 THEN '// a comment about coll.find( and new BasicDBObject("no", 1)'
  WHEN 6 THEN 'coll.updateOne(Filters.eq("status", s), u);'
  WHEN 7 THEN 'Statement st = conn.createStatement();'
  WHEN 8 THEN 'rs = st.executeQuery("SELECT * FROM t WHERE a = " + a);'
  WHEN 9 THEN 'String sql = "DELETE FROM t WHERE id = 1";'
  WHEN 10 THEN '@Indexed(unique = true)'
  WHEN 11 THEN '  private String field' || CAST(k % 3 AS STRING) || ';'
  WHEN 12 THEN 'coll = db.getCollection(AppConstants.F' || CAST(k % 5 AS STRING) || ');'
  WHEN 13 THEN ''
  WHEN 14 THEN 'query.put(AppConstants.F' || CAST(k % 40 AS STRING) || ', v);'
  WHEN 15 THEN 'coll.find(Filters.eq("tenant", t)).sort(Sorts.ascending("created"));'
  WHEN 16 THEN 'st.executeUpdate("UPDATE t SET a = 1");'
  ELSE CASE user_id % 5 WHEN 0 THEN 'template.findAll("carts");' WHEN 1 THEN 'template.drop("test");' ELSE 'mongoTemplate.find(q, Order' || CAST(user_id % 4 AS STRING) || '.class );' END END AS text
FROM (SELECT user_id, ts, event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))""",
    "constants_kv": "SELECT 'AppConstants' AS class, 'F' || CAST(n_nationkey AS STRING) AS field, lower(replace(n_name, ' ', '_')) AS value, n_nationkey AS seq FROM nation",
    "sql_statements": """
SELECT file_id, stmt_no, stmt_no * 2 - 1 AS line_no, raw_sql FROM (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey) AS INT) AS stmt_no, raw_sql FROM (SELECT o_custkey AS file_id, o_orderkey, CASE k
  WHEN 0 THEN 'DROP TABLE t' || CAST(j AS STRING)
  WHEN 1 THEN 'ALTER TABLE t' || CAST(j AS STRING) || ' DROP COLUMN c1'
  WHEN 2 THEN 'ALTER TABLE IF EXISTS t' || CAST(j AS STRING) || ' ADD COLUMN c2 INT'
  WHEN 3 THEN 'alter table t RENAME TO u'
  WHEN 4 THEN 'ALTER TABLE t ALTER COLUMN a TYPE BIGINT'
  WHEN 5 THEN 'CREATE INDEX ix_' || CAST(j AS STRING) || ' ON t' || CAST(j AS STRING) || ' (a, b DESC)'
  WHEN 6 THEN 'CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS ux ON ONLY t USING gin (a) INCLUDE (b) WHERE a > 1'
  WHEN 7 THEN 'CREATE TABLE t' || CAST(j AS STRING) || ' (id INT PRIMARY KEY)'
  WHEN 8 THEN 'TRUNCATE TABLE t' || CAST(j AS STRING)
  WHEN 9 THEN 'VACUUM FULL t'
  WHEN 10 THEN 'CLUSTER t USING ix'
  WHEN 11 THEN 'REINDEX SYSTEM db'
  WHEN 12 THEN 'REINDEX INDEX ix'
  WHEN 13 THEN 'ANALYZE t'
  WHEN 14 THEN 'ALTER TYPE mood ADD VALUE x'
  WHEN 15 THEN 'SELECT * FROM t' || CAST(j AS STRING)
  WHEN 16 THEN 'SELECT a, b FROM t x, u y WHERE x.id = y.id AND LOWER(x.name) = 1 ORDER BY x.a DESC, b LIMIT 5'
  WHEN 17 THEN 'DELETE FROM t' || CAST(j AS STRING)
  WHEN 18 THEN 'UPDATE t SET a = 1 WHERE b LIKE ''%x'''
  WHEN 19 THEN 'SELECT a FROM t JOIN u ON t.id = u.tid JOIN v ON u.id = v.uid WHERE t.a > 1 OFFSET 20000'
  WHEN 20 THEN 'SELECT a FROM t CROSS JOIN u'
  WHEN 21 THEN 'SELECT a FROM t ORDER BY RANDOM()'
  WHEN 22 THEN CASE WHEN j < 4 THEN 'INSERT INTO t (a) VALUES (1)' ELSE 'SELECT a FROM t WHERE a NOT IN (1) AND b NOT LIKE ''x'' AND c = 2' END
  ELSE '-- note' || chr(10) || 'DROP DATABASE d' || CAST(j AS STRING) END AS raw_sql
FROM (SELECT o_custkey, o_orderkey, o_orderkey % 24 AS k, o_orderkey % 9 AS j FROM orders)))""",
    "ddl_columns": """
SELECT 't' || CAST(t AS STRING) AS table_name, ord,
  CASE ord % 6 WHEN 1 THEN 'id' WHEN 2 THEN 'status' WHEN 3 THEN 't' || CAST((t + 1) % 20 AS STRING) || '_id' ELSE 'c' || CAST(ord AS STRING) END AS name,
  CASE p_size % 12 WHEN 0 THEN 'JSON' WHEN 1 THEN 'TIMESTAMP WITHOUT TIME ZONE' WHEN 2 THEN 'SERIAL' WHEN 3 THEN 'NUMERIC' WHEN 4 THEN 'VARCHAR(5000)'
    WHEN 5 THEN 'VARCHAR(20)' WHEN 6 THEN 'NUMERIC(10,2)' WHEN 7 THEN 'BIGINT' WHEN 8 THEN 'TEXT' WHEN 9 THEN 'JSONB' WHEN 10 THEN 'CHARACTER VARYING(4001)' ELSE 'INT' END AS data_type,
  p_size % 2 = 0 AS nullable, p_size % 5 = 0 AS has_default, t % 3 > 0 AND ord <= t % 6 AS is_pk
FROM (SELECT p_partkey % 20 AS t, p_size, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS INT) AS ord FROM part)""",
    "fk_edges": """
SELECT s_suppkey / 8 AS f, CAST(floor(s_suppkey / 8.0) AS INT) AS file_id, 't' || CAST(s_nationkey % 6 AS STRING) AS src, 't' || CAST(s_suppkey % 6 AS STRING) AS dst,
  CASE WHEN s_suppkey % 3 = 0 THEN 'k' ELSE 'c' END || CAST(s_suppkey % 4 AS STRING) AS cols FROM supplier""",
    "migration_files": """
SELECT 'd' || CAST(o_custkey % 10 AS STRING) AS dir, 'V' || CAST(o_orderkey AS STRING) || '__x.sql' AS name FROM orders
UNION ALL SELECT 'd' || CAST(o_custkey % 10 AS STRING), CASE o_orderkey % 2 WHEN 0 THEN 'undo_V' || CAST(o_orderkey AS STRING) || '__x.sql' ELSE 'V' || CAST(o_orderkey AS STRING) || '__x.rollback.sql' END
FROM orders WHERE o_orderkey % 3 = 0""",
    "service_catalog": """
SELECT r_name AS namespace, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ' Team ' || n_name END AS team, c_name AS service_name, c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN 'sub' ELSE '' END AS sub_team,
  CASE WHEN c_acctbal < 0 THEN 'Service not found' ELSE 'git/' || c_name END AS uri_location,
  CASE c_custkey % 5 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'MongoDB' WHEN 2 THEN 'MongoDB, PostgreSQL' WHEN 3 THEN 'none' ELSE '' END AS db_service
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "env_vars": """
SELECT c_name AS service, 'KEY_' || CAST(c_custkey % 6 AS STRING) AS key, c_custkey AS seq, CASE c_custkey % 6
  WHEN 0 THEN 'jdbc:postgresql://h' || CAST(c_nationkey AS STRING) || ':6432/db' || CAST(c_custkey % 9 AS STRING)
  WHEN 1 THEN 'postgres://h' || CAST(c_nationkey AS STRING) || '/orders'
  WHEN 2 THEN 'mongodb://u:p@m' || CAST(c_nationkey AS STRING) || ':27018/shop'
  WHEN 3 THEN 'mongodb+srv://m' || CAST(c_nationkey AS STRING) || '/shop?x=1'
  WHEN 4 THEN 'redis://r' ELSE c_mktsegment END AS value FROM customer""",
    "plans": """
SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'Seq Scan on t  (cost=0.00..1.00 rows=' || CAST(o_orderkey AS STRING) || ' width=4)'
  WHEN 1 THEN 'Nested Loop  (rows=7)' || chr(10) || '  Index Scan using a on t' || chr(10) || '  Seq Scan on u'
  ELSE 'Bitmap Index Scan on a (rows=3)' || chr(10) || 'Index Only Scan using b on t' END || chr(10) || 'Execution Time: ' || CAST(o_custkey % 100 AS STRING) || '.5 ms' AS plan_text FROM orders""",
    "plan_trees": """
SELECT o_orderkey AS query_id, 'Sort  (cost=1.00..2.00 rows=' || CAST(o_custkey AS STRING) || ' width=4) (actual time=0.010..' || CAST(o_custkey % 90 + 60 AS STRING) || '.250 rows=9 loops=1)' || chr(10) || '  Sort Key: a' || chr(10)
  || CASE o_orderkey % 3 WHEN 0 THEN '  InitPlan 1' || chr(10) || '    ->  Limit  (cost=0.00..0.10 rows=1 width=4) (actual time=0.002..0.003 rows=1 loops=1)' || chr(10)
    || '          ->  Index Only Scan using ix on v w  (cost=0.00..0.10 rows=3 width=4) (actual time=0.001..0.002 rows=1 loops=1)' || chr(10) ELSE '' END
  || '  ->  Hash Join  (cost=0.50..1.90 rows=7 width=4) (actual time=0.100..50.125 rows=' || CAST(o_orderkey % 40 AS STRING) || ' loops=1)' || chr(10) || '        Hash Cond: (t.a = u.b)' || chr(10)
  || '        ->  Seq Scan on t  (cost=0.00..1.00 rows=100 width=4) (actual time=0.001..' || CAST(o_custkey % 7 AS STRING) || '.500 rows=' || CAST(o_orderkey % 11 AS STRING) || ' loops=' || CAST(o_orderkey % 5 + 1 AS STRING) || ')' || chr(10)
  || '          Filter: (a > 1)' || chr(10) || '        ->  Hash  (cost=0.20..0.20 rows=1 width=4)' || CASE o_orderkey % 2 WHEN 0 THEN ' (never executed)' ELSE ' (actual time=0.000..2.000 rows=1 loops=1)' END || chr(10)
  || '              ->  Bitmap Heap Scan on u  (cost=0.00..0.20 rows=1 width=4)' || chr(10) || 'Planning Time: 0.100 ms' || chr(10) || 'Execution Time: 99.5 ms' AS plan_text FROM orders""",
    "live_catalog": """
SELECT 'ix_' || CAST(p_partkey AS STRING) AS index_name, 't' || CAST(p_partkey % 40 AS STRING) AS table_name,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey * 8192 + p_size END AS size_bytes, CAST(p_size % 4 AS BIGINT) AS idx_scan FROM part""",
    "script_lines": """
SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, k, CASE k % 6
  WHEN 0 THEN 'coll = db["c' || CAST(k % 4 AS STRING) || '"]'
  WHEN 1 THEN 'coll.find_one({"a' || CAST(k % 5 AS STRING) || '": 1, "$or": x, "_id": 2})'
  WHEN 2 THEN '# coll.find({"no": 1})'
  WHEN 3 THEN 'coll.update_many({"b": 1})'
  WHEN 4 THEN 'coll.create_index("c")'
  ELSE '  "d" : {"$gt": 1},' END AS text
FROM (SELECT user_id, ts, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "java_classes": """
SELECT 'p' || CAST(p_partkey AS STRING) || '.java' AS path, p_partkey AS n, p_size AS z, '@Document(collection = "c' || CAST(p_partkey % 7 AS STRING) || '")' || chr(10)
  || CASE p_size % 3 WHEN 0 THEN '@CompoundIndexes({ @CompoundIndex(name = "ab", def = "{''a'': 1, ''b'': -1}", unique = true) })' || chr(10) ELSE '' END
  || CASE p_size % 4 WHEN 0 THEN '@CompoundIndex(def = "{''s'': 1}")' || chr(10) ELSE '' END
  || 'public class C {' || chr(10) || '  @Indexed(unique = true, expireAfterSeconds = 60)' || chr(10)
  || CASE p_size % 5 WHEN 0 THEN '  // ' || repeat('x', 600) || chr(10) WHEN 1 THEN '  @NotNull' || chr(10) ELSE '' END
  || '  private String f' || CAST(p_size AS STRING) || ';' || chr(10) || '}' AS content FROM part""",
    "annotated_classes": """
SELECT 'q' || CAST(p_partkey AS STRING) || '.java' AS path, p_partkey AS n, p_size AS z, '@Document(collection = "k' || CAST(p_partkey % 5 AS STRING) || '")' || chr(10)
  || '@CompoundIndexes({' || chr(10) || '  @CompoundIndex(name = "by(f", def = "{''F' || CAST(p_partkey % 40 AS STRING) || ''': 1, ''plain'': -1}", sparse = true), // :)' || chr(10)
  || '  @CompoundIndex(def = "{''bad'': ' || CASE p_size % 3 WHEN 0 THEN '2' ELSE '-1' END || '}") })' || chr(10) || 'class Q {' || chr(10)
  || CASE p_size % 4 WHEN 0 THEN '  @TextIndexed(weight = 2) ' WHEN 1 THEN '  @GeoSpatialIndexed(type = GeoSpatialIndexType.GEO_2DSPHERE) ' WHEN 2 THEN '  @HashIndexed' || repeat(' ', 400) ELSE '  @WildcardIndexed' || chr(10) END
  || ' Map<String, Object> F' || CAST(p_size AS STRING) || ' = null;' || chr(10) || CASE p_size % 5 WHEN 0 THEN '  @Indexed(unique = true' ELSE '' END || chr(10) || '}' AS content FROM part""",
    "table_scripts": """
SELECT o_orderkey AS n, 'CREATE TABLE IF NOT EXISTS s.t' || CAST(o_custkey % 50 AS STRING) || ' (' || chr(10) || '  id INT' || CASE o_orderkey % 2 WHEN 0 THEN ' PRIMARY KEY' ELSE '' END || ', -- a comment, with (' || chr(10)
  || '  a NUMERIC(10, 2) CONSTRAINT "in range" CHECK (a > 0 AND (a < 9 OR b = '')'')) DEFAULT (1 + 2), b TEXT REFERENCES other(k) ON DELETE CASCADE' || chr(10)
  || CASE o_orderkey % 3 WHEN 0 THEN ', CONSTRAINT "Fk" FOREIGN KEY (a, "B c") REFERENCES s."Target t" (x, y)' WHEN 1 THEN ', FOREIGN KEY (c' || CAST(o_custkey % 9 AS STRING) || ') REFERENCES t' || CAST(o_custkey % 7 AS STRING) ELSE '' END
  || CASE o_orderkey % 5 WHEN 0 THEN ', constraint u unique nulls not distinct (a, b)' WHEN 1 THEN ', UNIQUE (b)' WHEN 2 THEN ', CHECK (a <> ' || CAST(o_custkey AS STRING) || ')' WHEN 3 THEN ', EXCLUDE USING gist (a WITH =)' ELSE ', check_date DATE' END
  || CASE o_orderkey % 2 WHEN 1 THEN ', CONSTRAINT pk PRIMARY KEY (id, a)' ELSE '' END || ') WITH (fillfactor = 70)' AS sql FROM orders""",
    "setting_files": """
SELECT 's' || CAST(n_nationkey AS STRING) || '/' || CASE n_nationkey % 4 WHEN 0 THEN 'application.properties' WHEN 1 THEN '.env' WHEN 2 THEN 'A.java' ELSE 'other.properties' END AS path, CASE n_nationkey % 4
  WHEN 0 THEN '# mongodb.database=no' || chr(10) || 'spring.data.mongodb.database=' || lower(replace(n_name, ' ', '_'))
  WHEN 1 THEN 'MY_MONGO_DB="e' || CAST(n_nationkey AS STRING) || '"'
  WHEN 2 THEN 'x.getDatabase("j' || CAST(n_nationkey AS STRING) || '"); y.getDB("admin");' ELSE 'mongodb.database=zz' END AS content, n_nationkey AS n FROM nation""",
    "deploy_files": """
SELECT CAST(n_nationkey AS STRING) || '/' || CASE n_nationkey % 4 WHEN 0 THEN 'x.yaml' WHEN 1 THEN 'Jenkinsfile' WHEN 2 THEN 'x.txt' ELSE 'build/y.yaml' END AS path, CASE n_nationkey % 4
  WHEN 1 THEN 'def x = "inc' || CAST(n_nationkey AS STRING) || '_$' || '{t}"; db = "local"'
  ELSE 'database: d' || CAST(n_nationkey AS STRING) || chr(10) || 'uri: mongodb+srv://h/u' || CAST(n_nationkey AS STRING) END AS content, n_nationkey AS n FROM nation""",
    "project_files": """
SELECT 'm' || CAST(p_partkey AS STRING) || CASE p_size % 8 WHEN 0 THEN '/Order.java' WHEN 1 THEN '/OrderTest.java' WHEN 2 THEN '/test/X.java' WHEN 3 THEN '/DataBackupJob.java' WHEN 4 THEN '/x.py'
  WHEN 5 THEN '/y.TS' WHEN 6 THEN '/build/G.kt' ELSE CASE p_partkey % 2 WHEN 0 THEN '/z.yml' ELSE '/readme.md' END END AS path, p_size AS z, p_partkey AS n FROM part""",
    "yaml_files": """
SELECT c_custkey AS n, 'git/svc' || CAST(c_custkey AS STRING) || '/values.yaml' AS path, CASE c_custkey % 9 WHEN 7 THEN '- only: a list' WHEN 8 THEN 'broken: {' ELSE
  'env:' || chr(10) || '  - name: DB_URL' || chr(10) || '    value: jdbc:postgresql://h' || CAST(c_nationkey AS STRING) || '/db' || chr(10) || '  - name: EMPTY' || chr(10) || '  - plain' || chr(10)
  || 'Db:' || chr(10) || '  Host: "h ' || c_mktsegment || '"' || chr(10) || '  port: ' || CAST(5000 + c_custkey AS STRING) || chr(10) || '  none:' || chr(10)
  || CASE c_custkey % 3 WHEN 0 THEN 'pools:' || chr(10) || '  - name: Main' || chr(10) || '    value: {Host: inner, size: "7"}' || chr(10) ELSE '' END
  || CASE c_custkey % 2 WHEN 0 THEN 'db: {host: later}' || chr(10) ELSE '' END END AS content FROM customer""",
    "mixed_ends": "SELECT doc_id, replace(replace(translate(text, 'qxj', chr(13) || chr(11) || chr(12)), 'the', chr(13) || chr(10)), 'en', chr(10) || chr(10)) AS text FROM documents",
    "values_paths": "SELECT 'svc' || CAST(n_nationkey AS STRING) || CASE n_nationkey % 3 WHEN 0 THEN '/values.yaml' WHEN 1 THEN '/values-prod.yaml' ELSE '/other.yaml' END AS path FROM nation",
    "index_scripts": """
SELECT s_suppkey AS file_id, 'db.t1.createIndex({a' || CAST(s_suppkey AS STRING) || ': 1, c: "text"});' || chr(10) || 'db["t2"].create_index([("b", DESCENDING), (''h'', HASHED)])' || chr(10)
  || 'coll.createIndex({x: 1}); users.createIndex({"y": -1}, {unique: true})' AS content FROM supplier""",
}
#: The column lists of indexes, per engine: aggregates of strings have no common form.
LISTS = {
    "spark": "array_join(transform(array_sort(collect_list(named_struct('n', l_linenumber, 'p', l_partkey))), x -> concat('c', cast(x.p % 4 as string))), ',')",
    "duckdb": "string_agg('c' || CAST(l_partkey % 4 AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)",
}
INDEX_DEFS = """
SELECT 't' || CAST(l_orderkey % 50 AS STRING) AS table_name, 'ix_' || CAST(l_orderkey AS STRING) AS index_name, l_orderkey AS seq, {0} AS cols
FROM lineitem GROUP BY l_orderkey"""


def register(spark: SparkSession, sf_dir: str):
    """A function that gives a table in ``sf_dir`` or a corpus by its name; only what is asked for, and the tables that it is made of, is opened.
    The views of these tables are replaced by those of a later call."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def view(name: str) -> DataFrame:
        if name not in CORPORA and name != "index_defs":
            return table(name)
        sql = INDEX_DEFS.format(LISTS["spark"]) if name == "index_defs" else CORPORA[name]
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                table(t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return view


def duckdb_sql(sql: str, *recursive: str) -> str:
    """The SQL of an oracle with the corpora that it names in front."""
    found = {name: text for name, text in {**CORPORA, "index_defs": INDEX_DEFS.format(LISTS["duckdb"])}.items() if name in sql}
    parts = [f"{name} AS ({text.replace('AS STRING', 'AS VARCHAR')})" for name, text in found.items()]
    parts += recursive
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:] if not parts else ", " + body[5:].lstrip()
        return f"WITH RECURSIVE {', '.join(parts)}{body}"
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
