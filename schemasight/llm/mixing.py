"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, numbered, running_before, settle, table

#: Weights and curriculum ramps (the schedule's factor at the start and at the end) of the sources in turn.
WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
WORDS = r"[^\x20\x09-\x0D]+"


def turns(rank: Column, values) -> Column:
    """The value of ``values`` whose turn it is for a rank counted from 1."""
    return F.get(F.array(*[F.lit(float(x)) for x in values]), (rank - 1) % len(values))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, ramps=RAMPS) -> DataFrame:
    """For each source (source, source_size): its rank, target, and schedule (from, to).

    Weighted shares of ``share`` times all sizes; where a share is above ``most`` times the source's
    size, it stops there and the rest is shared again by weight. In order of capacity for each unit
    of weight, sources that stop come first; what remains, divided by the remaining weight, is the
    level at which the others meet. One row per source passes through the window, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", turns(F.col("rank"), weights)).withColumn("from", turns(F.col("rank"), [a for a, _ in ramps])).withColumn("to", turns(F.col("rank"), [b for _, b in ramps]))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "rank", "source_size", "target", "from", "to")


def position(done: Column, start: Column, end: Column) -> Column:
    """The time (0 to 1) at which a schedule that moves evenly from ``start`` to ``end`` has asked for the share ``done``."""
    return F.when(start == end, done).otherwise((F.sqrt(start * start + (end - start) * (start + end) * done) - start) / (end - start))


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


PLANNED = ("source_size", "target", "copies", "taken", "positions")


def plan_mix(df: DataFrame, key: str = "key", size: str = "size", **options) -> DataFrame:
    """Add source_size, target, copies, taken and positions (of the copies, ascending) to rows with source and a size.

    The documents of a source stand in a row, in the order of ``key`` (hex digits, see
    mixing_key); the source
    runs through them again from the start until its target is met. A copy is taken when its middle
    is below the target, so the words taken differ from it by half a document at most, and no document is
    taken more often than ``most``. The position inverts the source's cumulative demand at that middle.
    A null source is a source of its own (last). Nothing is taken of a source with target 0. Equal
    rows are told apart by place only. Columns of these five names are replaced, others may have any names; an empty table gives
    an empty one. ``df`` is read several times, so give a table or a settled one.
    """
    df = df.drop(*PLANNED)
    names = list(df.columns)
    rank, source, begin, end, before = (fresh(names, f"_{x}") for x in ("rank", "source", "from", "to", "before"))
    s = targets(df.groupBy("source").agg(F.sum(size).alias("source_size")), **options)
    s = s.select(F.col("source").alias(source), F.col("rank").alias(rank), "source_size", "target", F.col("from").alias(begin), F.col("to").alias(end))
    rows = df.join(s, F.col("source").eqNullSafe(F.col(source))).drop(source)
    rows = running_before(rows, rank, [key], F.col(size), before, F.conv(F.substring(key, 1, 6), 16, 10).cast("long"))
    most = int(options.get("most", 2.0))
    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: k * F.col("source_size") + F.col(before) + F.col(size) / 2)
    middles = F.filter(middles, lambda m: m < F.col("target"))
    places = F.transform(middles, lambda m: position(m / F.col("target"), F.col(begin), F.col(end)))
    rows = rows.withColumn("positions", places).withColumn("copies", F.size("positions").cast("long"))
    return rows.withColumn("taken", F.col("copies") * F.col(size)).select(*names, *PLANNED)


def mix(df: DataFrame, key: str = "key", size: str = "size", **options) -> DataFrame:
    """The mixed corpus: a row for each copy taken, sorted by its position in training (column position, replaced if there is one).

    The plan is made without texts, of places, sources, sizes and keys; each row meets its positions once. Positions are spread over
    ranges, so no task holds more than a part of the corpus; the columns of the plan are left out.
    """
    row = fresh(df.columns)
    df = numbered(df.drop("position", *PLANNED), row).withColumn(row, F.struct(F.xxhash64(f"{row}.file").alias("file"), F.col(f"{row}.row").alias("row")))
    light = settle(df.select(F.col(row).alias("at"), "source", F.col(size).alias("size"), F.col(key).alias("key")))
    places = settle(plan_mix(light, **options).select(F.col("at").alias(row), F.explode("positions").alias("position")))
    discard(light)
    return in_training_order(df.join(places, row).drop(row), "position", key)


def in_training_order(df: DataFrame, position: str, key: str) -> DataFrame:
    """Rows sorted by position over ranges, those of one position by key; rows without one come last. However many rows have no position,
    or that of texts without words, the key deals them out over ranges, too."""
    order = [F.col(position).asc_nulls_last(), F.col(key).asc_nulls_last()]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def mixing_key(doc_id: Column, text: Column) -> Column:
    """What orders documents at random but repeatably: a digest of id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def op9_mixing(spark, sf_dir):
    """All documents, mixed to weights 3, 1, 2 over 150 % of their words, sorted by their first position in training."""
    docs = table(spark, sf_dir, "documents")
    docs = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixing_key(F.col("doc_id"), F.col("text")).alias("key")))
    out = in_training_order(settle(plan_mix(docs).withColumn("first_position", F.get("positions", F.lit(0)))), "first_position", "key")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), ranked AS (
  SELECT source, source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) AS INTEGER) AS rank
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)
), weighed AS (
  SELECT *, CAST(list_extract([3.0, 1.0, 2.0], (rank - 1) % 3 + 1) AS DOUBLE) AS weight, CAST(list_extract([1.5, 0.5, 1.0], (rank - 1) % 3 + 1) AS DOUBLE) AS a,
    CAST(list_extract([0.5, 1.5, 1.0], (rank - 1) % 3 + 1) AS DOUBLE) AS b, source_size * 2.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT *, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CAST((before + size / 2.0::DOUBLE < target) AS BIGINT) + CAST((source_size + before + size / 2.0::DOUBLE < target) AS BIGINT) AS copies,
    (before + size / 2.0::DOUBLE) / target AS done
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
  CASE WHEN copies > 0 THEN CASE WHEN a = b THEN done ELSE (sqrt(a * a + (b - a) * (a + b) * done) - a) / (b - a) END END AS first_position
FROM taken
"""
