"""Operators on lines of code: frames, offsets, first matches and as-of lookups. Lines are (file_id, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from schemasight.functions.text import all_matches, first_match, is_comment, latest_match, lower_first
from schemasight.registry import COLLECTIONS, NOT_COLLECTIONS, NOT_LITERALS, OLDER_COLLECTIONS, OPERATIONS, QUERY_FIELDS, Pattern

#: How many lines back a query's operation may stand.
TOLERANCE = 50


def by_file() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("line_no")


def with_context(lines: DataFrame, around: int = 2) -> DataFrame:
    """Add context: the line with ``around`` lines before and after, trimmed."""
    frame = by_file().rowsBetween(-around, around)
    return lines.withColumn("context", F.btrim(F.array_join(F.collect_list("text").over(frame), "\n"), F.lit(" \n\t\r")))


def with_offset(lines: DataFrame) -> DataFrame:
    """Add start: the number of characters before the line in its file, line ends included."""
    return lines.withColumn("start", F.coalesce(F.sum(F.char_length("text") + 1).over(by_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def scan_lines(lines: DataFrame, patterns, marks=("//", "#")) -> DataFrame:
    """Lines that match a pattern, without regard to case: type of the first one, and the context; comments and blank lines are skipped."""
    found = with_context(lines).withColumn("type", first_match(F.col("text"), patterns, "(?i)"))
    return found.where(F.col("type").isNotNull() & ~is_comment(F.col("text"), *marks)).select("file_id", "line_no", "type", F.btrim("text").alias("match"), "context")


def operation_of(lines: DataFrame, patterns: list[Pattern] = OPERATIONS) -> DataFrame:
    """Add operation: that of the latest line up to this one with a call, at most TOLERANCE lines back; else 'unknown'. One window, no join."""
    own = first_match(F.col("text"), patterns)
    seen = F.last(F.when(own.isNotNull(), F.struct(own.alias("op"), F.col("line_no").alias("at"))), ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("operation", F.coalesce(F.when(F.col("line_no") - seen["at"] < TOLERANCE, seen["op"]), F.lit("unknown")))


def is_no_collection(kind: Column, value: Column) -> Column:
    """Whether a match names no collection: a word that patterns find by mistake, or a literal that is reserved or too short."""
    literal = (kind == "literal") & (value.isin(NOT_LITERALS) | (F.char_length(value) < 3))
    return literal | ((kind != "constant") & value.isin(NOT_COLLECTIONS))


def collection_of(lines: DataFrame, constants: DataFrame) -> DataFrame:
    """Add collection: the latest reference that starts before this line or at its start, constants and entity classes resolved; else 'unknown'.

    ``constants``: (name, value), one row a name. The references are resolved before the window, so the
    join is between references and constants, not all lines.
    """
    lines = lines.withColumn("_ref", latest_match(F.col("text"), COLLECTIONS, lambda x: ~is_no_collection(x["kind"], x["value"])))
    lines = lines.withColumn("_name", F.when(F.col("_ref.kind") == "constant", F.col("_ref.value")))
    known = constants.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    lines = lines.join(known, "_name", "left")
    value = F.when(F.col("_ref.kind") == "entity", lower_first(F.col("_ref.value"))).otherwise(F.coalesce("_value", "_ref.value"))
    own = F.when(F.col("_ref").isNotNull() & ~value.isin(NOT_COLLECTIONS), value)
    lines = lines.withColumn("_own", own)
    before = F.last("_own", ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1))
    here = F.when(F.col("_ref.pos") == 1, F.col("_own"))
    return lines.withColumn("collection", F.coalesce(here, before, F.lit("unknown"))).drop("_ref", "_name", "_value", "_own")


def field_usages(lines: DataFrame, constants: DataFrame) -> DataFrame:
    """Fields that queries use: (file_id, line_no, ord, nth, collection, field, usage, operation).

    usage: equality, range or sort. One expression may be found by several patterns and then counts for each. Comments and
    blank lines are skipped, operators ($...) and _id are no fields.
    """
    return usages_in(collection_of(operation_of(lines), constants), constants)


def usages_in(placed: DataFrame, constants: DataFrame) -> DataFrame:
    """``field_usages`` of lines that have operation and collection."""
    found = placed.where(~is_comment(F.col("text"), "//", "*")).select("file_id", "line_no", "collection", "operation", F.explode(all_matches(F.col("text"), QUERY_FIELDS)).alias("m"))
    found = found.select("file_id", "line_no", "collection", "operation", "m.*")
    known = constants.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    found = found.withColumn("_name", F.when(F.col("kind") == "constant", F.col("value"))).join(known, "_name", "left")
    field = F.coalesce("_value", "value")
    usage = F.when(F.col("kind") == "constant", "equality").otherwise(F.col("kind"))
    out = found.select("file_id", "line_no", "ord", "nth", "collection", field.alias("field"), usage.alias("usage"), "operation")
    return out.where(~F.col("field").startswith("$") & (F.col("field") != "_id"))


def older_findings(lines: DataFrame, fields: list[Pattern], operations: list[Pattern]) -> DataFrame:
    """What the older analysis finds in lines: (file_id, line_no, ord, nth, field, usage, operation, collection, collection_type).

    Constants stay names. Blank lines and those that start with //, # or * are skipped, and so are operators ($...) and _id.
    """
    ref = latest_match(F.col("text"), OLDER_COLLECTIONS)
    placed = operation_of(lines, operations).withColumn("_ref", ref)
    before = F.last("_ref", ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1))
    at = F.coalesce(F.when(F.col("_ref.pos") == 1, F.col("_ref")), before)
    placed = placed.withColumn("_at", at).where(~is_comment(F.col("text"), "//", "#", "*"))
    found = placed.select("file_id", "line_no", "operation", "_at", F.explode(all_matches(F.col("text"), fields)).alias("m"))
    unknown = F.lit("unknown")
    out = found.select("file_id", "line_no", "m.ord", "m.nth", F.col("m.value").alias("field"), F.col("m.kind").alias("usage"), "operation", F.coalesce("_at.value", unknown).alias("collection"), F.coalesce("_at.kind", unknown).alias("collection_type"))
    return out.where(~F.col("field").startswith("$") & (F.col("field") != "_id"))


def constants_map(constants: DataFrame) -> DataFrame:
    """(name, value) of constants (class, field, value, seq): qualified and bare names; of equal names the last wins."""
    both = constants.select(F.explode(F.array(F.concat_ws(".", "class", "field"), F.col("field"))).alias("name"), "value", "seq")
    return both.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def resolved(names: DataFrame, constants: DataFrame) -> DataFrame:
    """Add value to (name): that of the constant, else the name."""
    return names.join(constants.select("name", "value"), "name", "left").withColumn("value", F.coalesce("value", "name"))
