"""Source files as tables: (path, name, content) and their lines."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight.functions import sqltext as S
from schemasight.functions import text as T
from schemasight.registry import CATEGORIES, ENV_FILES, SETTING_FILES, SKIP_DIRS
from schemasight.sources.tree import can_open, is_hidden, is_wanted, qualified, read_tree


def hidden_files(spark: SparkSession, root: str, wanted: Callable[[str], bool]) -> list[tuple[str, str, bytes]]:
    """(path, name, content) of the wanted files that Spark's readers leave out: those called, or in directories called, with . or _ in front. They are settings
    and scripts of people's making, a few a project; the file system of the root lists and reads them on the driver. Skipped directories are not entered."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    base, out, todo = fs.makeQualified(top).toString().rstrip("/") + "/", [], [(top, False)]
    while todo:
        directory, inside = todo.pop()
        for status in fs.listStatus(directory):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in SKIP_DIRS:
                    todo.append((status.getPath(), inside or is_hidden(name)))
            elif (inside or is_hidden(name)) and wanted(name):
                stream = fs.open(status.getPath())
                try:
                    data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
                out.append((status.getPath().toString().removeprefix(base), name, data))
    return sorted(out)


def spark_files(spark: SparkSession, root: str, names: list[str], endings: list[str]) -> DataFrame:
    """What ``read_tree`` gives, from a store that tasks can't open by themselves: read by Spark, which leaves out empty files, hidden ones by the driver."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.col("_metadata.file_name")
    tests = [name.rlike(fnmatch.translate(p)) for p in names] + [F.lower(name).endswith(e.lower()) for e in endings]
    wanted = reduce(Column.__or__, tests, F.lit(False))
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^\w+:/*", "/")
    base = F.lit(re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/")
    out = df.where(wanted).select(F.lit(root).alias("root"), F.when(path.startswith(base), F.substr(path, F.char_length(base) + 1)).otherwise(path).alias("path"), name.alias("name"), "content")
    more = [(root, f, n, bytearray(c)) for f, n, c in hidden_files(spark, root, lambda n: is_wanted(n, names, endings))]
    return out.unionByName(spark.createDataFrame(more, "root string, path string, name string, content binary")) if more else out


def tree(spark: SparkSession, roots: list[str], names: list[str], endings: list[str], opened: bool = True) -> DataFrame:
    """(root, path, name, content): the files of all roots, content as bytes; only files with a wanted name are opened, or none (content is null then). Root is as given."""
    full = [(r, qualified(spark, r)) for r in roots]
    if can_open(spark, [uri for _, uri in full]):
        return read_tree(spark, full, names, endings, opened)
    parts = [spark_files(spark, uri, names, endings).withColumn("root", F.lit(r)) for r, uri in full]
    out = reduce(DataFrame.unionByName, parts)
    return out if opened else out.withColumn("content", F.lit(None).cast("binary"))


def paths(spark: SparkSession, root: str) -> DataFrame:
    """(path, name) of all files below ``root``; none is opened."""
    return tree(spark, [root], ["*"], [], opened=False).select("path", "name")


def decoded(df: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with content as text. Bytes that are no UTF-8 are replaced, or, with ``strict``, make it empty."""
    text = F.col("content").cast("string")
    return df.withColumn("content", F.when(F.is_valid_utf8(text), text).otherwise("" if strict else F.make_valid_utf8(text)))


def files(spark: SparkSession, root: str | list[str], pattern: str = "*", strict: bool = False, names: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """All files below ``root`` whose name matches ``pattern``: path (relative to root; below its root's path with several roots), name, content.

    With ``names`` (patterns) or ``endings`` (in any case) these decide instead. Files with other names are not opened, and a scan lists a
    directory once. Hidden files are read too, but for those in skipped directories.
    Bytes that are no UTF-8 are replaced, or, with ``strict``, make the content empty (see ``unreadable``).
    """
    roots = [root] if isinstance(root, str) else list(root)
    df = tree(spark, roots, [pattern] if names is None and endings is None else names or [], endings or [])
    path = F.col("path") if isinstance(root, str) else F.concat(F.regexp_replace(F.regexp_replace("root", r"^\w+:/*", "/"), "/*$", "/"), "path")
    return decoded(df, strict).select(path.alias("path"), "name", "content")


def unreadable(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, error) of the files below ``root`` that are no UTF-8."""
    df = tree(spark, [root], [pattern], [])
    return df.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.concat("path", F.lit(": not valid UTF-8")).alias("error"))


def java_sources(spark: SparkSession, root: str, queries_only: bool = False) -> DataFrame:
    """Java files outside skipped and test directories, without tests; with ``queries_only`` without files named like migrations, mocks and so on."""
    found = files(spark, root, "*.java").where(~T.in_skipped_dir(F.col("path")) & ~T.is_test_file(F.col("name")))
    return found.where(~T.is_non_query_file(F.col("name"))) if queries_only else found


def constant_sources(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, "*.java").where(~T.in_skipped_dir(F.col("path"), tests=False) & F.col("name").rlike(r"(?:Constants|Config)\.java$"))


def migrations(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """SQL files by path, none left out: (dir, path, name, content)."""
    return files(spark, root, "*.sql").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))


def by_category(found: DataFrame) -> DataFrame:
    """Files of known extensions with their category: java, python, javascript or config."""
    return found.withColumn("category", T.category(F.col("path"))).where("category is not null")


def projects(found: DataFrame) -> DataFrame:
    """Add project: the first directory of the path; files at the root belong to none and are dropped, like skipped directories."""
    parts = F.split("path", "/")
    return found.where(F.size(parts) > 1).withColumn("project", parts[0]).where(~T.in_skipped_dir(F.col("path"), tests=False))


def setting_sources(spark: SparkSession, root: str) -> DataFrame:
    """The files in which a project names its databases: settings, environments and Java classes."""
    return files(spark, root, names=[*SETTING_FILES, *ENV_FILES, "*.java"])


def script_sources(spark: SparkSession, root: str) -> DataFrame:
    """Python, JavaScript and TypeScript files outside skipped directories."""
    found = files(spark, root, endings=CATEGORIES["python"] + CATEGORIES["javascript"])
    return found.where(~T.in_skipped_dir(F.col("path"), tests=False))


def lines(found: DataFrame, id_col: str = "path") -> DataFrame:
    """(file_id, line_no, text) of all files."""
    return found.select(F.col(id_col).alias("file_id"), F.posexplode(T.split_lines(F.col("content"))).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line_no"), "text")


def statements(found: DataFrame, id_col: str = "path") -> DataFrame:
    """(file_id, stmt_no, line_no, raw_sql) of all scripts: each is split once for all rules."""
    return found.select(F.col(id_col).alias("file_id"), F.explode(S.split_sql(F.col("content"))).alias("s")).select("file_id", "s.*")


def constants(found: DataFrame) -> DataFrame:
    """(class, field, value, seq) of public string constants; seq orders them by path and place."""
    pattern = r'public\s+static\s+final\s+String\s+(\w+)\s*=\s*"([^"]*)"'
    names, values = (F.regexp_extract_all("content", F.lit(pattern), F.lit(k)) for k in (1, 2))
    rows = found.select("path", T.stem(F.col("name")).alias("class"), F.posexplode(F.arrays_zip(names.alias("field"), values.alias("value"))).alias("pos", "c"))
    return rows.select("class", F.col("c.field").alias("field"), F.col("c.value").alias("value"), F.struct("path", "pos").alias("seq"))
