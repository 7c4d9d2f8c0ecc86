"""Finding what a project is made of: files by kind, databases that settings and code name, values files, connection keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemasight.functions import text as T
from schemasight.registry import (
    CODE_DATABASES, DATABASE_CONSTANTS, DEPLOY_DATABASES, DEPLOY_EXTENSIONS, DEPLOY_FILES, ENV_DATABASES, ENV_FILES, NOT_DATABASE_CONSTANTS, NOT_DEPLOY_DATABASES,
    SETTING_DATABASES, SETTING_FILES, URI_KEYS,
)


def categorised(files: DataFrame) -> DataFrame:
    """Files (path) of known extensions outside skipped directories, with their category."""
    return files.withColumn("category", T.category(F.col("path"))).where(F.col("category").isNotNull() & ~T.in_skipped_dir(F.col("path"), tests=False))


def query_files(files: DataFrame) -> DataFrame:
    """Java files (path) that may hold production queries: no skipped or test directories, no tests, no names like migrations and mocks."""
    name = T.base_name(F.col("path"))
    return files.where(name.endswith(".java") & ~T.in_skipped_dir(F.col("path")) & ~T.is_test_file(name) & ~T.is_non_query_file(name))


def _names(text: Column, patterns: list[str], first: bool) -> Column:
    """Array of (ord, name): what the patterns find in a text, all matches or the first of each."""

    def of(k: int, p: str) -> Column:
        found = F.array(F.regexp_extract(text, p, 1)) if first else F.regexp_extract_all(text, F.lit(p), F.lit(1))
        return F.transform(found, lambda x, i: F.struct(F.lit(k).alias("ord"), i.alias("nth"), F.btrim(F.btrim(x), F.lit("\"'")).alias("name")))

    return F.concat(*[of(k, p) for k, p in enumerate(patterns)])


def first_seen(found: DataFrame) -> DataFrame:
    """(name, path) of the names of (path, line_no, ord, nth, name), each where it is seen first."""
    place = F.struct("path", "line_no", "ord", "nth")
    return found.groupBy("name").agg(F.min(place).alias("_at")).select("name", F.col("_at.path").alias("path"), "_at")


def database_names(files: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """(name, path, seq) of the databases that a project names, each where it is seen first: in lines of its setting and environment
    files, in its Java classes and, after all files, in constants (name, value) called like databases."""
    name = T.base_name(F.col("path"))
    files = files.where(~T.in_skipped_dir(F.col("path"), tests=False))
    lines = files.where(name.isin(SETTING_FILES + ENV_FILES)).select("path", name.isin(SETTING_FILES).alias("setting"), F.posexplode(T.split_lines(F.col("content"))).alias("line_no", "text"))
    lines = lines.withColumn("text", F.btrim("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    lines = lines.select("path", "line_no", F.explode(F.when(F.col("setting"), _names(F.col("text"), SETTING_DATABASES, True)).otherwise(_names(F.col("text"), ENV_DATABASES, True))).alias("x"))
    code = files.where(name.endswith(".java")).select("path", F.lit(0).alias("line_no"), F.explode(_names(F.col("content"), CODE_DATABASES, False)).alias("x"))
    found = lines.unionByName(code).select("path", "line_no", "x.*")
    if constants is not None:
        up = F.upper("name")
        has = lambda words: up.rlike("|".join(words))
        known = constants.where(has(DATABASE_CONSTANTS) & ~has(NOT_DATABASE_CONSTANTS))
        # after every path
        found = found.unionByName(known.select(F.lit("\U0010ffff").alias("path"), F.lit(0).alias("line_no"), F.lit(0).alias("ord"), F.lit(0).alias("nth"), F.col("value").alias("name")))
    out = first_seen(found.where(T.is_database_name(F.col("name"))))
    return out.select("name", F.when(F.col("path") != "\U0010ffff", F.col("path")).alias("path"), F.col("_at").alias("seq"))


def deployed_databases(files: DataFrame) -> DataFrame:
    """(name, path, seq) of the databases that a repository of deployment settings names, each where it is seen first."""
    name = T.base_name(F.col("path"))
    wanted = (T.extension(F.col("path")).isin(DEPLOY_EXTENSIONS) | name.isin(DEPLOY_FILES)) & ~T.in_skipped_dir(F.col("path"), tests=False)
    found = files.where(wanted).select("path", F.lit(0).alias("line_no"), F.explode(_names(F.col("content"), DEPLOY_DATABASES, False)).alias("x")).select("path", "line_no", "x.*")
    good = ~F.col("name").isin(NOT_DEPLOY_DATABASES) & (F.char_length("name") >= 2) & ~F.col("name").startswith("$")
    return first_seen(found.where(good)).withColumnRenamed("_at", "seq")


def with_primary_database(found: DataFrame, names: DataFrame) -> DataFrame:
    """Indexes or suggestions with database filled, where it is null, with the name (name, seq) that is seen first of all: one row, joined to all."""
    first = names.agg(F.min_by("name", "seq").alias("_primary"))
    if "database" not in found.columns:
        found = found.withColumn("database", F.lit(None).cast("string"))
    return found.crossJoin(F.broadcast(first)).withColumn("database", F.coalesce("database", "_primary")).drop("_primary")  # an aggregate of one row


def values_files(files: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """(service, path): the values files (path) that a catalog (service_name, uri_location) names and that exist; without a catalog, all
    values*.yaml, the service being their directory."""
    if services is None:
        return files.where(T.base_name(F.col("path")).rlike(r"^values.*\.yaml$")).select(F.element_at(F.split("path", "/"), -2).alias("service"), "path")
    named = services.where((F.btrim(F.coalesce("uri_location", F.lit(""))) != "") & ~F.lower("uri_location").contains("service not found"))
    return named.select(F.col("service_name").alias("service"), F.col("uri_location").alias("path")).join(files.select("path").distinct(), "path").select("service", "path")


def key_kind(key: Column) -> Column:
    """What a setting's key says that its value is: mongodb or postgresql (a connection), host or name; else null. Dots and dashes count as underscores."""
    plain = F.translate(F.lower(key), "-.", "__")
    out = F.lit(None).cast("string")
    for kind, keys in reversed(URI_KEYS.items()):
        out = F.when(plain.isin([k.replace(".", "_") for k in keys]), kind).otherwise(out)
    return out


def first_by_name(indexes: DataFrame, *by: str) -> DataFrame:
    """Indexes without those of a name that an earlier one (seq) has, in case too; ``by``: what names are unique in."""
    return indexes.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "index_name").orderBy("seq"))).where("_nth = 1").drop("_nth")
