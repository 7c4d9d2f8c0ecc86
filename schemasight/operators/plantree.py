"""Plans as trees: a row for each node of an EXPLAIN text, with what its subtree does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = r"^(\s*)->\s+"


def _figure(line: Column, pattern: str, kind: str) -> Column:
    return F.regexp_extract(line, pattern, 1).try_cast(kind)


def _total(items: Column, name: str, kind: str) -> Column:
    return F.aggregate(F.transform(items, lambda x: F.coalesce(x[name], F.lit(0)).cast(kind)), F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def placed(text: Column) -> Column:
    """Array of (node, parent, depth, line) of a plan's nodes: its first line and the lines with an arrow, numbered from 1. The parent is the nearest
    node before it that is indented less, null for the first; labels such as InitPlan are no nodes, what stands under them belongs to the node around."""
    lines = F.filter(F.split(text, "\n"), lambda x, i: ((i == 0) & (F.btrim(x) != "")) | x.rlike(ARROW))
    indented = F.transform(lines, lambda x, i: F.struct((i + 1).alias("node"), F.when(x.rlike(ARROW), F.length(F.regexp_extract(x, ARROW, 1))).otherwise(-1).alias("indent"), x.alias("line")))
    empty = F.struct(F.array().cast("array<struct<indent:int,node:int>>").alias("open"), F.array().cast("array<struct<node:int,parent:int,depth:int,line:string>>").alias("out"))

    def step(seen: Column, x: Column) -> Column:
        above = F.filter(seen["open"], lambda o: o["indent"] < x["indent"])
        row = F.struct(x["node"].alias("node"), F.get(above, F.size(above) - 1)["node"].alias("parent"), F.size(above).alias("depth"), x["line"].alias("line"))
        return F.struct(F.concat(above, F.array(F.struct(x["indent"].alias("indent"), x["node"].alias("node")))).alias("open"), F.concat(seen["out"], F.array(row)).alias("out"))

    return F.aggregate(indented, empty, step, lambda seen: seen["out"])


def plan_nodes(plans: DataFrame, id_col: str = "query_id", text_col: str = "plan_text") -> DataFrame:
    """(id, node, parent, depth, operation, estimated, rows, ms, own_ms, subtree_nodes, subtree_rows) of all nodes of plans in text form.

    rows and ms are the actual ones of all loops, ms with the node's subtree as the database reports it, own_ms without its children;
    null for nodes that were never executed or plans that were only estimated. subtree_rows sums rows over the node and all
    below it. Null and empty plans give no rows. A plan is read in one projection without a shuffle; its work grows with the square of its own nodes.
    """
    def read(x: Column) -> Column:
        line = x["line"]
        loops = _figure(line, r"actual [^)]*loops=(\d+)", "long")
        return F.struct(
            x["node"].alias("node"), x["parent"].alias("parent"), x["depth"].alias("depth"),
            F.regexp_extract(F.regexp_replace(line, ARROW, ""), r"^\s*(.*?)\s*(?:\s{2}\(.*)?$", 1).alias("operation"),
            _figure(line, r"\(cost=[^)]*rows=(\d+)", "long").alias("estimated"),
            (_figure(line, r"\(actual [^)]*rows=(\d+)", "long") * loops).alias("rows"),
            (_figure(line, r"\(actual time=[\d.]+\.\.([\d.]+)", "decimal(18,3)") * loops).cast("decimal(18,3)").alias("ms"),
        )

    nodes = plans.select(id_col, F.transform(placed(F.col(text_col)), read).alias("all")).withColumn("x", F.explode("all"))
    x = F.col("x")
    behind = F.filter("all", lambda y: (y["node"] > x["node"]) & (y["depth"] <= x["depth"]))
    below = F.coalesce(F.get(behind, F.lit(0))["node"], F.size("all") + 1) - x["node"]
    rows = nodes.select(id_col, "x", F.slice("all", x["node"], below).alias("tree"))
    children = F.filter("tree", lambda y: y["parent"] == x["node"])
    own = x["ms"] - _total(children, "ms", "decimal(18,3)")
    return rows.select(
        id_col, "x.node", "x.parent", "x.depth", "x.operation", "x.estimated", "x.rows", x["ms"].cast("double").alias("ms"), own.cast("double").alias("own_ms"),
        F.size("tree").cast("long").alias("subtree_nodes"), _total(F.col("tree"), "rows", "long").alias("subtree_rows"),
    )


def slowest_nodes(nodes: DataFrame, id_col: str = "query_id") -> DataFrame:
    """The node of each plan that takes the most time itself (id, node, operation, own_ms, share): of equal ones the first; share is its part of the
    whole time, null where that is zero. Plans that were not executed have none."""
    timed = nodes.where("own_ms is not null")
    best = timed.groupBy(id_col).agg(F.max_by(F.struct("node", "operation", "own_ms"), F.struct(F.col("own_ms"), -F.col("node"))).alias("best"), F.max(F.when(F.col("node") == 1, F.col("ms"))).alias("whole"))
    return best.select(id_col, "best.node", "best.operation", "best.own_ms", F.when(F.col("whole") > 0, F.round(F.col("best.own_ms") / F.col("whole"), 6)).alias("share"))
