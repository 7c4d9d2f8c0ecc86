"""The queries on whole inputs: what a prefix or a subset would leave out counts here."""

import duckdb

from schemasight import oracle
from schemasight.queries import QUERIES


def test_collection_filter_reads_whole_texts(spark, sf):
    sql = f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS name FROM '{sf}/documents.parquet') WHERE NOT {oracle.skipped('name')} GROUP BY doc_id"
    want = dict(duckdb.sql(sql).fetchall())
    assert {r.doc_id: r.n for r in QUERIES["collection_filter"](spark, sf).collect()} == want
    assert max(want.values()) > 20


def index_defs(spark, sf):
    """(seq, table, columns) of every order, made in loops."""
    lines = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey))
    return [(k, f"t{k % 50}", [f"c{p % 4}" for _, p in sorted(v)]) for k, v in lines.items()]


def test_create_plan_has_every_index(spark, sf):
    regions = [r.r_name.lower() for r in spark.read.parquet(f"{sf}/region.parquet").collect()]
    want = sorted((d, t, f"ix_{k}") for d in regions for k, t, _ in index_defs(spark, sf))
    assert sorted(map(tuple, QUERIES["create_plan"](spark, sf).select("database", "table_name", "index_name").collect())) == want


def test_coverage_judges_every_index(spark, sf):
    live = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        live.setdefault(f"t{r.p_partkey % 50}", []).append(sorted({f"c{n % 4}" for n in (r.p_size, len(r.p_name), r.p_partkey, len(r.p_type))}))
    for name, room in (("pg_coverage", 99), ("doc_coverage", 2)):
        want = {k: "exists" if any(set(c) <= set(have[: len(set(c)) + room]) for have in live.get(t, [])) else "missing" for k, t, c in index_defs(spark, sf)}
        got = QUERIES[name](spark, sf).collect()
        assert len(got) == len(want) and {r.id: r.status for r in got} == want
        assert set(want.values()) == {"exists", "missing"}


def test_prefix_has_every_pair(spark, sf):
    """Each pair of indexes by name, not classes with counts."""
    named = {}
    for k, t, c in index_defs(spark, sf):
        named.setdefault(t, []).append((f"ix_{k}", c))
    want = sorted((t, a, b) for t, all_of in named.items() for a, c in all_of for b, d in all_of if len(c) < len(d) and d[: len(c)] == c)
    assert sorted(map(tuple, QUERIES["idx_prefix"](spark, sf).select("table_name", "index_name", "longer").collect())) == want and want
