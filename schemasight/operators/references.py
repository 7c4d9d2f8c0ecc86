"""Collections that whole files refer to: matches may span lines, and every one of them counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemasight.functions.text import lower_first
from schemasight.operators.lines import is_no_collection
from schemasight.registry import COLLECTIONS, Pattern


def references(files: DataFrame, patterns: list[Pattern] = COLLECTIONS) -> DataFrame:
    """(file_id, pos, ord, kind, value) of every match in (file_id, content); pos counts characters from 0.

    Spark's functions tell what matches and, by splitting, what stands between the matches; the lengths of both, added up, tell where each match is.
    """
    found = []
    for k, p in enumerate(patterns):
        regex = f"(?U){p.regex}"  # letters and blanks of all scripts, as in names
        whole, value = (F.regexp_extract_all("content", F.lit(regex), F.lit(n)) for n in (0, 1))
        parts = F.arrays_zip(F.split("content", regex, -1).alias("between"), whole.alias("whole"), value.alias("value"))
        rows = F.transform(parts, lambda x, n: F.struct(F.lit(k).alias("ord"), n.alias("nth"), F.char_length(x["between"]).alias("between"), F.char_length(x["whole"]).alias("whole"), x["value"].alias("value")))
        found.append(F.filter(rows, lambda x: x["whole"].isNotNull()))
    rows = files.select("file_id", F.explode(F.concat(*found)).alias("m")).select("file_id", "m.*")
    one = Window.partitionBy("file_id", "ord").orderBy("nth")
    earlier = F.sum("whole").over(one.rowsBetween(Window.unboundedPreceding, -1))
    pos = F.sum("between").over(one.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(earlier, F.lit(0))
    kinds = F.array(*[F.lit(p.kind) for p in patterns])
    return rows.select("file_id", pos.alias("pos"), "ord", F.get(kinds, "ord").alias("kind"), "value")


def named(refs: DataFrame, constants: DataFrame) -> DataFrame:
    """(file_id, pos, ord, name): references with constants and entity classes resolved, without those that name no collection."""
    known = constants.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    found = refs.withColumn("_name", F.when(F.col("kind") == "constant", F.col("value"))).join(known, "_name", "left")
    name = F.when(F.col("kind") == "entity", lower_first(F.col("value"))).otherwise(F.coalesce("_value", "value"))
    found = found.withColumn("name", name).where(~is_no_collection(F.col("kind"), F.col("value")) & ~is_no_collection(F.lit("name"), F.col("name")))
    return found.select("file_id", "pos", "ord", "name")


def collection_at(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Add collection to lines (file_id, line_no, start, ...): the reference (file_id, pos, ord, name) that starts last at or before the line's start,
    the earlier pattern of equal ones; else 'unknown'. Lines and references are sorted together once, in one window a file."""
    names = list(lines.columns)
    both = lines.withColumns({"_at": F.col("start"), "_ord": F.lit(-1), "_name": F.lit(None).cast("string")})
    given = refs.select("file_id", F.col("pos").alias("_at"), F.col("ord").alias("_ord"), F.col("name").alias("_name"))
    both = both.unionByName(given, allowMissingColumns=True)
    # of equal places: later patterns, earlier ones, then the line
    order = Window.partitionBy("file_id").orderBy("_at", F.desc("_ord")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("collection", F.coalesce(F.last("_name", ignorenulls=True).over(order), F.lit("unknown"))).where("_ord = -1")
    return found.select(*names, "collection")
