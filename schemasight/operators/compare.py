"""Comparisons of declared, suggested, scripted and live indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemasight.functions.text import fields_key

#: Collections with fewer documents need no index.
SMALL = 50


def compared(script: DataFrame, code: DataFrame) -> DataFrame:
    """Script indexes against those of the code, by (collection, set of field:direction): status both, script_only or code_only."""
    key = fields_key(F.split("fields", ","))
    a = script.select("collection", key.alias("key")).distinct().withColumn("in_script", F.lit(True))
    b = code.select("collection", key.alias("key")).distinct().withColumn("in_code", F.lit(True))
    both = a.join(b, ["collection", "key"], "full_outer")
    return both.select("collection", "key", F.when(F.col("in_script") & F.col("in_code"), "both").when(F.col("in_script"), "script_only").otherwise("code_only").alias("status"))


def combined(code: DataFrame, suggested: DataFrame) -> DataFrame:
    """Indexes of the code and suggestions, one row a (collection, set of fields); a suggestion replaces what the code has."""
    key = fields_key(F.split("fields", ","))
    rows = code.select("collection", "fields", F.lit(0).alias("p")).unionByName(suggested.select("collection", "fields", F.lit(1).alias("p"))).withColumn("key", key)
    return rows.groupBy("collection", "key").agg(F.max_by("fields", F.struct("p", "fields")).alias("fields"), F.max("p").alias("suggested"))


def covered_sql(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Add status to wanted (id, table_name, cols): 'exists' if some live index of the table has all its columns, else 'missing'.

    Each wanted index meets the live ones of its table that have its first column, not all.
    """
    w = wanted.select("id", F.lower("table_name").alias("table_name"), F.transform("cols", F.lower).alias("want"))
    alive = live.select(F.lower("table_name").alias("table_name"), F.array_sort(F.array_distinct(F.transform("cols", F.lower))).alias("have")).distinct()
    alive = alive.select("table_name", "have", F.explode("have").alias("lead"))
    hit = w.withColumn("lead", F.col("want")[0]).join(alive, ["table_name", "lead"]).where(F.size(F.array_except("want", "have")) == 0).select("id").distinct()
    return wanted.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_hit"), "exists").otherwise("missing")).drop("_hit")


def covers_documents(want: Column, have: Column) -> Column:
    """Whether a live index covers wanted fields: the same set, or all of them among the first n + 2 of its names in alphabetical order."""
    front = F.slice(F.array_sort(have), 1, F.size(want) + 2)
    return (F.size(F.array_except(want, front)) == 0) | (fields_key(want) == fields_key(have))


def covered_documents(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Add status to wanted (id, collection, cols) by the rule of ``covers_documents``."""
    alive = live.select("collection", F.array_sort(F.array_distinct("cols")).alias("have")).distinct().select("collection", "have", F.explode("have").alias("lead"))
    hit = wanted.withColumn("lead", F.col("cols")[0]).join(alive, ["collection", "lead"]).where(covers_documents(F.array_distinct("cols"), F.col("have"))).select("id").distinct()
    return wanted.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_hit"), "exists").otherwise("missing")).drop("_hit")


def tenants(names: DataFrame, live: DataFrame) -> DataFrame:
    """Live databases of each name in the code: equal, or ending in _name or -name. Live names are filed under all their endings, so it is an equi-join."""
    parts = F.transform(F.filter(F.sequence(F.lit(1), F.char_length("live")), lambda k: (k == 1) | F.substr(F.col("live"), k - 1, F.lit(1)).isin("_", "-")), lambda k: F.substr(F.col("live"), k))
    endings = live.select("live", F.explode(F.array_distinct(parts)).alias("name"))
    return names.select("name").distinct().join(endings, "name").select("name", "live").distinct()


def eligibility(suggested: DataFrame, sizes: DataFrame, small: int = SMALL) -> DataFrame:
    """Add status to suggestions (collection): collection_not_found, small_collection or eligible; sizes has (collection, docs)."""
    known = sizes.groupBy("collection").agg(F.max((F.col("docs") < small).cast("int")).alias("_small"))
    return suggested.join(known, "collection", "left").withColumn("status", F.when(F.col("_small").isNull(), "collection_not_found").when(F.col("_small") == 1, "small_collection").otherwise("eligible")).drop("_small")


def esr(defs: DataFrame, usages: DataFrame) -> DataFrame:
    """Whether the fields of live indexes (collection, index_name, cols) stand in the order equality, sort, range, by how code uses them.

    Adds classes (a letter a field, ? unknown), compliant, and better: the fields in that order.
    """
    kinds = usages.groupBy("collection", "field").agg(F.max((F.col("usage") == "sort").cast("int")).alias("s"), F.max((F.col("usage") == "range").cast("int")).alias("r"))
    fields = defs.select("collection", "index_name", F.posexplode("cols").alias("pos", "field")).join(kinds, ["collection", "field"], "left")
    letter = F.when(F.col("s") == 1, "S").when(F.col("r") == 1, "R").when(F.col("s") == 0, "E").otherwise("?")
    rows = fields.groupBy("collection", "index_name").agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c"), "field"))).alias("f"))
    classes = F.array_join(F.transform("f", lambda x: x["c"]), "")
    rank = lambda c: F.when(c == "E", 1).when(c == "S", 2).when(c == "R", 3).otherwise(4)
    ordered = F.array_sort(F.transform("f", lambda x: F.struct(rank(x["c"]).alias("k"), x["pos"].alias("pos"), x["field"].alias("field"))))
    return rows.select("collection", "index_name", classes.alias("classes"), (~F.replace(classes, F.lit("?"), F.lit("")).rlike("SE|RE|RS")).alias("compliant"), F.array_join(F.transform(ordered, lambda x: x["field"]), ",").alias("better"))


def reordering(classes: Column, better: Column, compliant: Column) -> Column:
    """What to do about an index of ``esr``: its fields in the better order with the classes in theirs; null if nothing."""
    letters = F.filter(F.split(classes, ""), lambda c: c != "")
    ranked = F.transform(F.array_sort(F.transform(letters, lambda c: F.struct(F.array_position(F.array(*map(F.lit, "ESR?")), c).alias("k"), c.alias("c")))), lambda x: x["c"])
    parts = F.zip_with(F.split(better, ","), ranked, lambda f, c: F.concat(f, F.lit("("), c, F.lit(")")))
    return F.when(~compliant, F.concat(F.lit("Reorder to ESR: "), F.array_join(parts, " → ")))


def without_default(indexes: DataFrame) -> DataFrame:
    """Live indexes (database, fields as name:dir) without those on _id alone and those of system databases."""
    return indexes.where((F.col("fields") != "_id:1") & ~F.col("database").isin("admin", "local", "config"))


def creation_plan(databases: DataFrame, indexes: DataFrame) -> DataFrame:
    """What would be created: every index in every target database. This product is the feature; nothing is executed."""
    return databases.select("database").distinct().crossJoin(indexes)
