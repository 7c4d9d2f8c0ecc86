"""Plans as trees, on plans as the database prints them."""

from schemasight.operators.plantree import plan_nodes, slowest_nodes

PLAN = """Limit  (cost=0.42..8.44 rows=1 width=36) (actual time=0.020..5.000 rows=1 loops=1)
  InitPlan 1 (returns $0)
    ->  Aggregate  (cost=1.00..1.01 rows=1 width=8) (actual time=0.500..1.000 rows=1 loops=1)
          ->  Seq Scan on small s  (cost=0.00..1.00 rows=10 width=4) (actual time=0.010..0.250 rows=10 loops=1)
                Filter: (note <> '->  Seq Scan (x)'::text)
  ->  Nested Loop  (cost=0.42..8.44 rows=1 width=36) (actual time=0.018..3.500 rows=1 loops=1)
        ->  Index Scan using t_pkey on t  (cost=0.42..8.44 rows=1 width=36) (actual time=0.010..0.500 rows=4 loops=1)
        ->  Index Only Scan using u_b on u  (cost=0.42..8.44 rows=1 width=36) (actual time=0.100..0.500 rows=2 loops=4)
        ->  Materialize  (cost=0.42..8.44 rows=1 width=36) (never executed)
Planning Time: 0.080 ms
Execution Time: 5.100 ms"""


def test_nodes(spark):
    got = plan_nodes(spark.createDataFrame([(1, PLAN)], "query_id long, plan_text string")).orderBy("node").collect()
    assert [(r.node, r.parent, r.depth, r.operation) for r in got] == [
        (1, None, 0, "Limit"), (2, 1, 1, "Aggregate"), (3, 2, 2, "Seq Scan on small s"), (4, 1, 1, "Nested Loop"), (5, 4, 2, "Index Scan using t_pkey on t"),
        (6, 4, 2, "Index Only Scan using u_b on u"), (7, 4, 2, "Materialize"),
    ]
    assert [r.ms for r in got] == [5.0, 1.0, 0.25, 3.5, 0.5, 2.0, None]
    assert [r.own_ms for r in got] == [0.5, 0.75, 0.25, 1.0, 0.5, 2.0, None]
    assert [r.rows for r in got] == [1, 1, 10, 1, 4, 8, None]
    assert [(r.subtree_nodes, r.subtree_rows) for r in got] == [(7, 25), (2, 11), (1, 10), (4, 13), (1, 4), (1, 8), (1, 0)]


def test_plans_without_figures(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Seq Scan on t"), (4, "Seq Scan on t  (cost=0.00..1.00 rows=3 width=4)")], "query_id long, plan_text string")
    nodes = plan_nodes(df)
    assert [(r.query_id, r.operation, r.estimated, r.ms, r.subtree_rows) for r in nodes.orderBy("query_id").collect()] == [(3, "Seq Scan on t", None, None, 0), (4, "Seq Scan on t", 3, None, 0)]
    assert slowest_nodes(nodes).count() == 0
    assert plan_nodes(df.where("false")).count() == 0


def test_deep_plan(spark):
    """A chain of 150 nodes."""
    lines = ["N0  (cost=0.00..1.00 rows=1 width=4) (actual time=0.000..150.000 rows=1 loops=1)"]
    lines += [" " * (6 * k - 4) + f"->  N{k}  (cost=0.00..1.00 rows=1 width=4) (actual time=0.000..{150 - k}.000 rows=1 loops=1)" for k in range(1, 150)]
    got = plan_nodes(spark.createDataFrame([(1, "\n".join(lines))], "query_id long, plan_text string")).orderBy("node").collect()
    assert [(r.parent, r.depth, r.own_ms, r.subtree_nodes) for r in got] == [(k or None, k, 1.0, 150 - k) for k in range(150)]


def test_slowest(spark):
    got = slowest_nodes(plan_nodes(spark.createDataFrame([(1, PLAN)], "query_id long, plan_text string"))).collect()
    assert [tuple(r) for r in got] == [(1, 6, "Index Only Scan using u_b on u", 2.0, 0.4)]
