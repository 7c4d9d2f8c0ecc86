"""Index suggestions from field usages, and what thins them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemasight.functions.text import fields_key, is_skipped_collection

#: The most fields of a compound suggestion, and the lines that make one candidate.
MOST_FIELDS, BUCKET = 5, 10


def usable(usages: DataFrame) -> DataFrame:
    return usages.where(~is_skipped_collection(F.col("collection")))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def single_fields(usages: DataFrame, scope: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """One suggestion for each (file, collection, field): priority by use, references, distinct operations, the first three places."""
    place = F.struct("line_no", "ord", "nth", F.concat_ws(":", F.col("file_id").cast("string"), F.col("line_no").cast("string")).alias("at"))
    # ranked in the partitions that the groups need anyway, so a group collects three places however often it is used
    order = Window.partitionBy(*scope, "collection", "field").orderBy("line_no", "ord", "nth", "file_id")
    ranked = usable(usages).withColumn("_rank", F.row_number().over(order))
    out = ranked.groupBy(*scope, "collection", "field").agg(
        F.count("*").alias("refs"), F.max((F.col("usage") == "sort").cast("int")).alias("_sort"), F.max((F.col("usage") == "range").cast("int")).alias("_range"),
        F.array_join(F.array_sort(F.collect_set("operation")), ", ").alias("operations"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= 3, place))).alias("_places"), F.min(place).alias("_first"),
    )
    priority = F.when((F.col("refs") >= 5) | (F.col("_sort") == 1), "high").when((F.col("refs") >= 2) | (F.col("_range") == 1), "medium").otherwise("low")
    samples = F.array_join(F.transform("_places", lambda p: p["at"]), ", ")
    return out.select(*scope, "collection", F.col("field").alias("fields"), priority.alias("priority"), "refs", "operations", samples.alias("samples"), F.lit("single").alias("kind"), F.col("_first.line_no").alias("first_line"))


def compound_fields(usages: DataFrame) -> DataFrame:
    """Suggestions of two to five fields used together: the same collection, file, operation and ten lines; fields of equality
    first, then sort, then range. Of buckets with the same fields in a file the first counts."""
    keys = ["file_id", "collection", "operation", "bucket"]
    spots = usable(usages).withColumn("bucket", F.floor(F.col("line_no") / BUCKET) * BUCKET)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "ord", "nth", "field", "usage")))
    out = spots.groupBy(*keys).agg(rows.alias("u"))

    def of(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter("u", lambda x: x["usage"] == kind), lambda x: x["field"]))

    equal, sort = of("equality"), F.array_except(of("sort"), of("equality"))
    fields = F.concat(equal, sort, F.array_except(F.array_except(of("range"), of("equality")), of("sort")))
    out = out.select(*keys, fields.alias("all"), F.size("u").alias("n"), F.col("u")[0]["line_no"].alias("first_line")).where(F.size("all") >= 2)
    out = out.withColumn("capped", F.slice("all", 1, MOST_FIELDS)).withColumn("key", fields_key(F.col("capped")))
    first = Window.partitionBy("file_id", "collection", "key").orderBy("first_line", "operation", "bucket")
    out = out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    priority = F.when(F.size("all") <= 3, "medium").otherwise("high")
    return out.select("file_id", "collection", F.array_join("capped", ",").alias("fields"), priority.alias("priority"), F.col("n").cast("long").alias("refs"), F.col("operation").alias("operations"), F.lit("compound").alias("kind"), "first_line")


def without_covered_singles(singles: DataFrame, compounds: DataFrame) -> DataFrame:
    """Singles without those of low priority whose field is in a compound suggestion of the same file and collection."""
    covered = compounds.select("file_id", "collection", F.explode(F.split("fields", ",")).alias("fields")).distinct().withColumn("priority", F.lit("low"))
    return singles.join(covered, ["file_id", "collection", "fields", "priority"], "left_anti")


def suggestions(usages: DataFrame) -> DataFrame:
    """All suggestions with their rank in the file: by priority, then references."""
    compounds = compound_fields(usages)
    singles = without_covered_singles(single_fields(usages), compounds)
    names = ["file_id", "collection", "fields", "priority", "refs", "operations", "kind", "first_line"]
    both = compounds.select(names).unionByName(singles.select(names))
    order = Window.partitionBy("file_id").orderBy(priority_rank(F.col("priority")), F.desc("refs"), "kind", "first_line", "collection", "fields", "operations")
    return both.withColumn("rank", F.row_number().over(order))


def without_indexed(found: DataFrame, indexes: DataFrame) -> DataFrame:
    """Suggestions without those whose collection has an index on the same set of fields, in any order. Both have (collection, fields)."""
    key = fields_key(F.split("fields", ","))
    return found.withColumn("_key", key).join(indexes.select("collection", key.alias("_key")).distinct(), ["collection", "_key"], "left_anti").drop("_key")


def first_of_equals(indexes: DataFrame) -> DataFrame:
    """Index declarations (collection, fields, unique, sparse, ttl, seq) without repeats: the first of each counts."""
    key = [F.col("collection"), fields_key(F.split("fields", ",")), F.col("unique"), F.col("sparse"), F.col("ttl")]
    return indexes.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("_nth = 1").drop("_nth")


def legacy_suggestions(usages: DataFrame) -> DataFrame:
    """The older rollup over all files: high from five uses or a sort operation, medium from two; ranges count as filters."""
    out = usages.where(F.col("collection") != "unknown").groupBy("collection", "field").agg(
        F.count("*").alias("refs"), F.count_distinct("file_id").alias("files"), F.array_join(F.array_sort(F.collect_set("operation")), ", ").alias("operations"), F.max((F.col("operation") == "sort").cast("int")).alias("_sort")
    )
    return out.withColumn("priority", F.when((F.col("refs") >= 5) | (F.col("_sort") == 1), "high").when(F.col("refs") >= 2, "medium").otherwise("low")).drop("_sort")
