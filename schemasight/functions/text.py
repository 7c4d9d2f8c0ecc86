"""Column functions on names, lines and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemasight.registry import CATEGORIES, NON_QUERY_WORDS, NOT_DATABASES, SKIP_COLLECTION_SUFFIXES, SKIP_COLLECTION_WORDS, SKIP_DIRS, TEST_DIRS, Pattern

#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def split_lines(text: Column) -> Column:
    """Lines of a text, without an empty one after the last line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def safe_name(name: Column) -> Column:
    return F.translate(name, " /", "__")


def lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))


def in_skipped_dir(path: Column, tests: bool = True) -> Column:
    """Whether a directory of the path is one that scans leave out."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, SKIP_DIRS + TEST_DIRS * tests)))


def is_test_file(name: Column) -> Column:
    return name.rlike(r"^Test|Tests?\.java$")


def is_non_query_file(name: Column) -> Column:
    return F.lower(name).rlike("|".join(NON_QUERY_WORDS))


def category(path: Column) -> Column:
    """java, python, javascript or config by the extension, else null."""
    out = F.lit(None).cast("string")
    for name, extensions in CATEGORIES.items():
        out = F.when(extension(path).isin(extensions), name).otherwise(out)
    return out


def is_comment(line: Column, *marks: str) -> Column:
    """Whether a line is blank or starts with one of the marks."""
    bare = F.btrim(line)
    out = bare == ""
    for mark in marks:
        out = out | bare.startswith(mark)
    return out


def first_match(text: Column, patterns: list[Pattern], flags: str = "") -> Column:
    """The kind of the first pattern that the text matches, else null; one pass, no join."""
    return F.coalesce(*[F.when(text.rlike(flags + p.regex), p.kind) for p in patterns])


def all_matches(text: Column, patterns: list[Pattern]) -> Column:
    """Array of (ord, kind, value) of every match of every pattern; value is its group."""

    def of(k: int, p: Pattern) -> Column:
        found = F.regexp_extract_all(text, F.lit(p.regex), F.lit(1))
        return F.transform(found, lambda x, i: F.struct(F.lit(k).alias("ord"), i.alias("nth"), F.lit(p.kind).alias("kind"), x.alias("value")))

    return F.concat(*[of(k, p) for k, p in enumerate(patterns)])


def latest_match(text: Column, patterns: list[Pattern], keep: Callable[[Column], Column] | None = None) -> Column:
    """struct(pos, before, kind, value) of the match that starts last, of those that ``keep`` holds for; of equal starts, that of the earlier pattern."""
    found = [F.when(text.rlike(p.regex), F.struct(F.regexp_instr(text, F.lit(p.regex)).alias("pos"), F.lit(-k).alias("before"), F.lit(p.kind).alias("kind"), F.regexp_extract(text, p.regex, 1).alias("value"))) for k, p in enumerate(patterns)]
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull() if keep is None else x.isNotNull() & keep(x)))


def is_skipped_collection(name: Column) -> Column:
    """Whether a collection needs no index suggestions: unknown, or named like a backup, a log and so on."""
    lower = F.lower(name)
    out = F.coalesce(name, F.lit("")).isin("", "unknown") | lower.rlike("|".join(SKIP_COLLECTION_WORDS))
    for suffix in SKIP_COLLECTION_SUFFIXES:
        out = out | lower.endswith(suffix)
    return F.coalesce(out, F.lit(True))


def is_database_name(name: Column) -> Column:
    """Whether a value found in a setting can be the name of a database."""
    cased = name.rlike("[A-Za-z]")
    capitals = cased & (F.upper(name) == name)
    camel = name.rlike("^[a-z].*[A-Z]") & ~F.lower(name).rlike("db|mongo")
    bad = ~F.char_length(name).between(2, 64) | name.rlike(r"^[${]") | name.isin(NOT_DATABASES) | (capitals & (F.char_length(name) > 3)) | (name.rlike("^[A-Z].*[A-Z]") & ~capitals) | camel
    return F.coalesce(~bad, F.lit(False))


def fields_key(fields: Column) -> Column:
    """A key that is equal for equal sets of names."""
    return F.array_join(F.array_sort(F.array_distinct(fields)), ",")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def database_uri(value: Column) -> dict[str, Column]:
    """kind (postgresql, mongodb), host, port and name of a database URI."""
    post = r"^(?:jdbc:)?postgres(?:ql)?://([^:/]+)(?::(\d+))?/(\w+)"
    mongo = r"^mongodb(?:\+srv)?://(?:[^@/]+@)?([^:/,]+)(?::(\d+))?[^/]*/(\w+)"
    kind = F.when(value.rlike(post), "postgresql").when(value.rlike(mongo), "mongodb")
    part = lambda k: F.when(value.rlike(post), F.regexp_extract(value, post, k)).when(value.rlike(mongo), F.regexp_extract(value, mongo, k))
    port = F.coalesce(F.nullif(part(2), F.lit("")), F.when(kind == "postgresql", "5432").when(kind == "mongodb", "27017")).try_cast("int")
    return {"kind": kind, "host": part(1), "port": port, "name": part(3)}
