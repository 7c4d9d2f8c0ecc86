"""Scripts that create or verify indexes, as rows of text, and their way back to specifications.

Specifications: (collection, index_name, fields array<struct<name, dir>>, unique)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def specs(defs: DataFrame) -> DataFrame:
    """Specifications from (table_name, index_name, seq, cols as text): columns named c3 are descending."""
    fields = F.transform(F.array_distinct(F.split("cols", ",")), lambda c: F.struct(c.alias("name"), F.when(c == "c3", -1).otherwise(1).alias("dir")))
    return defs.select(F.col("table_name").alias("collection"), "index_name", fields.alias("fields"), (F.col("seq") % 4 == 0).alias("unique"))


def joined(fields, f, sep: str = ", ") -> Column:
    return F.array_join(F.transform(fields, f), sep)


def text_of(n: Column) -> Column:
    return n.cast("string")


def mongo_shell(specs: DataFrame) -> DataFrame:
    quote = lambda d: F.when(text_of(d).rlike("^-?[0-9]+$"), text_of(d)).otherwise(F.concat(F.lit('"'), text_of(d), F.lit('"')))
    keys = joined("fields", lambda x: F.concat(F.lit('"'), x["name"], F.lit('": '), quote(x["dir"])))
    options = F.when(F.col("unique"), ", { unique: true }").otherwise("")
    return specs.select("collection", "index_name", F.concat(F.lit("db."), "collection", F.lit(".createIndex({ "), keys, F.lit(" }"), options, F.lit(");")).alias("line"))


def pymongo(specs: DataFrame) -> DataFrame:
    keys = joined("fields", lambda x: F.concat(F.lit('("'), x["name"], F.lit('", '), F.when(text_of(x["dir"]) == "-1", "DESCENDING").when(text_of(x["dir"]) == "text", "TEXT").when(text_of(x["dir"]) == "hashed", "HASHED").otherwise("ASCENDING"), F.lit(")")))
    options = F.when(F.col("unique"), ", unique=True").otherwise("")
    return specs.select("collection", "index_name", F.concat(F.lit('db["'), "collection", F.lit('"].create_index(['), keys, F.lit("]"), options, F.lit(")")).alias("line"))


def postgres(specs: DataFrame, schema: str = "public") -> DataFrame:
    """CREATE INDEX statements; names are built from the columns and cut to 63 characters."""
    name = F.substring(F.replace(F.concat(F.lit("idx_"), "collection", F.lit("_"), joined("fields", lambda x: x["name"], "_")), F.lit("."), F.lit("_")), 1, 63)
    cols = joined("fields", lambda x: F.concat(F.replace(x["name"], F.lit("."), F.lit("_")), F.when(text_of(x["dir"]) == "-1", " DESC").otherwise("")))
    start = F.when(F.col("unique"), "CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS ").otherwise("CREATE INDEX CONCURRENTLY IF NOT EXISTS ")
    return specs.select("collection", "index_name", F.concat(start, name, F.lit(f" ON {schema}."), "collection", F.lit(" ("), cols, F.lit(");")).alias("line"))


def verification(specs: DataFrame) -> DataFrame:
    """For each collection the specifications whose presence a script has to check."""
    keys = joined("fields", lambda x: F.concat(x["name"], F.lit("_"), text_of(x["dir"])), "_")
    return specs.select("collection", keys.alias("key")).distinct().groupBy("collection").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ";").alias("expected"))


def indexdef_columns(definition: Column) -> Column:
    """column:direction of the parentheses of an index definition, read to the last closing one."""
    body = F.regexp_extract(definition, r"\((.+)\)", 1)
    part = lambda c: F.concat(F.regexp_replace(F.btrim(c), r"(?i)\s+(?:ASC|DESC)\b.*$", ""), F.when(F.upper(c).contains(" DESC"), ":-1").otherwise(":1"))
    return F.array_join(F.transform(F.split(body, ","), part), ",")


#: What pymongo calls directions.
DIRECTIONS = {"1": "ASCENDING", "-1": "DESCENDING", "text": "TEXT", "hashed": "HASHED"}


def options(specs: DataFrame, shell: bool) -> Column:
    """unique, sparse and expireAfterSeconds of (unique, sparse, ttl), those that are set: as a shell object or as arguments; '' without any."""
    true, mark, quote = ("true", ": ", '"') if shell else ("True", "=", "")
    name = lambda n: f"{quote}{n}{quote}{mark}"
    parts = [F.when(F.col(c), name(c) + true) for c in ("unique", "sparse")] + [F.concat(F.lit(name("expireAfterSeconds")), F.col("ttl").cast("string"))]
    text = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(text == "", "").otherwise(F.concat(F.lit(", {"), text, F.lit("}")) if shell else F.concat(F.lit(", "), text))


def _sections(rows: DataFrame, *parts: tuple[int, str, Column | None]) -> DataFrame:
    """Lines in front of and behind groups of a script: (part, columns that make the group, line)."""
    out = None
    for part, by, line in parts:
        names = [c for c in by.split(",") if c]
        found = rows.select(*names).distinct() if names else rows.limit(1)
        found = found.select(*[F.col(c) if c in names else F.lit(None if part < 8 else "\U0010ffff").cast("string").alias(c) for c in ("database", "collection")], F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), line.alias("line"))
        out = found if out is None else out.unionByName(found)
    return out


def shell_script(specs: DataFrame, database: str | None = None) -> DataFrame:
    """A whole mongosh script of (database, collection, seq, fields, unique, sparse, ttl): (database, collection, part, seq, line), to be sorted by
    these with nulls first. Indexes are grouped by database, that given or their own, and by collection."""
    if database:
        return _shell_lines(specs.withColumn("database", F.lit(database)), False)
    some = specs.agg(F.max(F.col("database").isNotNull()).alias("_some"))
    rows = specs.crossJoin(F.broadcast(some)).withColumn("database", F.when(F.col("_some"), F.coalesce("database", F.lit("unknown")))).drop("_some")  # an aggregate of one row
    return _shell_lines(rows, True)


def _shell_lines(rows: DataFrame, named: bool) -> DataFrame:
    keys = joined("fields", lambda x: F.concat(F.lit('"'), x["name"], F.lit('": '), F.when(x["dir"].rlike("^-?[0-9]+$"), x["dir"]).otherwise(F.concat(F.lit('"'), x["dir"], F.lit('"')))))
    line = F.concat(F.lit("db."), "collection", F.lit(".createIndex({"), keys, F.lit("}"), options(rows, True), F.lit(");"))
    body = rows.select("database", "collection", F.lit(5).alias("part"), F.col("seq").cast("long").alias("seq"), line.alias("line"))
    heads = _sections(
        rows,
        (0, "", F.lit("// Auto-generated MongoDB index creation script")),
        (1, "", F.lit("// Generated from source code analysis")),
        (2, "", F.lit("")),
        (4, "database,collection", F.concat(F.lit("// Collection: "), "collection")),
        (6, "database,collection", F.lit("")),
    )
    known = rows.where("database is not null")
    use = _sections(known, (1, "database", F.concat(F.lit("// Database: "), "database")), (2, "database", F.concat(F.lit("use "), "database", F.lit(";"))), (3, "database", F.lit("")))
    return body.unionByName(heads).unionByName(use if named else use.where("part > 1"))


def pymongo_script(specs: DataFrame, database: str = "mydb") -> DataFrame:
    """A whole Python script of (collection, seq, fields, unique, sparse, ttl): (collection, part, seq, line), to be sorted by these with nulls first;
    it imports the directions that it needs."""
    names = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    word = lambda x: F.coalesce(names[x["dir"]], x["dir"])
    keys = joined("fields", lambda x: F.concat(F.lit('("'), x["name"], F.lit('", '), word(x), F.lit(")")))
    line = F.concat(F.lit('db["'), "collection", F.lit('"].create_index(['), keys, F.lit("]"), options(specs, False), F.lit(")"))
    body = specs.select("collection", F.lit(5).alias("part"), F.col("seq").cast("long").alias("seq"), line.alias("line"))
    needed = specs.select(F.explode(F.transform("fields", word)).alias("w")).agg(F.array_join(F.array_sort(F.collect_set("w")), ", ").alias("w"))  # a handful of words
    fixed = ["#!/usr/bin/env python3", '"""Auto-generated pymongo index creation script."""', "", None, "", 'client = MongoClient("mongodb://localhost:27017")', f'db = client["{database}"]', ""]
    head = needed.select(F.posexplode(F.array(*[F.concat(F.lit("from pymongo import MongoClient, "), "w") if x is None else F.lit(x) for x in fixed])).alias("seq", "line"))
    head = head.select(F.lit(None).cast("string").alias("collection"), F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"), "line")
    each = specs.select("collection").distinct().select("collection", F.explode(F.array(F.struct(F.lit(4).alias("part"), F.concat(F.lit("# Collection: "), "collection").alias("line")), F.struct(F.lit(6).alias("part"), F.lit("").alias("line")))).alias("x"))
    return body.unionByName(head).unionByName(each.select("collection", "x.part", F.lit(0).cast("long").alias("seq"), "x.line"))


def entries(text: Column, cut: str, entry: str) -> Column:
    """name:direction of the entries of a list: it is cut, and each piece read from its start by an expression with a group for the name and one or
    two for the direction. The words of pymongo become what they stand for; pieces that can't be read are left out."""
    words = F.create_map(*[F.lit(x) for number, word in DIRECTIONS.items() for x in (word, number)])

    def read(piece: Column) -> Column:
        direction = F.concat(F.regexp_extract(piece, entry, 2), F.regexp_extract(piece, entry, 3))
        return F.when(piece.rlike(entry), F.concat(F.regexp_extract(piece, entry, 1), F.lit(":"), F.coalesce(words[direction], direction)))

    return F.array_join(F.array_compact(F.transform(F.split(text, cut), read)), ",")


def shell_keys(text: Column) -> Column:
    """name:direction of the keys in a shell object, quoted or not: numbers, or text in double quotes. Of names with dots the last part counts."""
    return entries(text, ",", r"""^[\s{]*["']?(?:[\w$]+\.)*(\w+)["']?\s*:\s*(?:(-?\d+)|"([^"]*)")""")


def pymongo_keys(text: Column) -> Column:
    """name:direction of the tuples of a create_index call: numbers or pymongo's words."""
    return entries(text, r"\)", rf"""^[\s,\[(]*["'](\w+)["']\s*,\s*(?:(-?\d+)|({'|'.join(DIRECTIONS.values())}))\b""")


def calls(content: Column, method: str, brackets: str) -> Column:
    """Array of (receiver, body, raw) of the calls of a method whose first argument is a bracketed list: the text is cut at the method's name, so a
    call is what one piece ends with and the next begins with."""
    pieces = F.split(content, rf"\.{method}\b")
    body = rf"^\s*\(\s*(\{brackets[0]}[^\{brackets[1]}]+\{brackets[1]})"

    def at(k: Column) -> Column:
        receiver = F.regexp_extract(F.get(pieces, k), r"""(?:db\.)?\w+$|db\[(?:"\w+"|'\w+')\]$""", 0)
        behind = F.get(pieces, k + 1)
        return F.struct(receiver.alias("receiver"), F.regexp_extract(behind, body, 1).alias("body"), F.concat(receiver, F.lit(f".{method}"), F.regexp_extract(behind, body, 0)).alias("raw"))

    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pieces) - 2, F.lit(0))), at)
    return F.filter(every, lambda c: (c["receiver"] != "") & (c["body"] != ""))


def script_calls(scripts: DataFrame) -> DataFrame:
    """(file_id, ord, nth, collection, fields, raw) of all calls in scripts (file_id, content) with keys: 0 shell calls on db, 1 Python calls on db, 2
    shell calls on anything; those on variables called db, collection and coll are left out. A shell call with db is of both kinds and
    counts twice; comparisons, which are by collection and keys, see it once."""
    shell, python = calls(F.col("content"), "createIndex", "{}"), calls(F.col("content"), "create_index", "[]")
    kinds = [
        F.filter(shell, lambda c: c["receiver"].startswith("db.")),
        F.filter(python, lambda c: c["receiver"].startswith("db[")),
        F.transform(F.filter(shell, lambda c: ~c["receiver"].endswith("]")), lambda c: F.struct(F.regexp_replace(c["receiver"], r"^db\.", "").alias("receiver"), c["body"].alias("body"), F.regexp_replace(c["raw"], r"^db\.", "").alias("raw"))),
    ]

    def numbered(k: int, found: Column) -> Column:
        name = lambda c: F.regexp_extract(c["receiver"], r"(\w+)\W*$", 1).alias("collection")
        return F.transform(found, lambda c, n: F.struct(F.lit(k).alias("ord"), n.alias("nth"), name(c), c["body"].alias("body"), c["raw"].alias("raw")))

    found = scripts.select("file_id", F.explode(F.concat(*[numbered(k, found) for k, found in enumerate(kinds)])).alias("c")).select("file_id", "c.*")
    found = found.where((F.col("ord") < 2) | ~F.col("collection").isin("db", "collection", "coll"))
    fields = F.when(F.col("ord") == 1, pymongo_keys(F.col("body"))).otherwise(shell_keys(F.col("body")))
    return found.withColumn("fields", fields).where("fields <> ''").select("file_id", "ord", "nth", "collection", "fields", "raw")


def parsed_shell(lines: DataFrame) -> DataFrame:
    """(collection, index_name, fields as name:dir, unique) of createIndex lines."""
    body = F.regexp_extract("line", r"createIndex\(\{([^}]*)\}", 1)
    names = F.regexp_extract_all(body, F.lit(r'"?([\w.]+)"?\s*:\s*"?-?\w+'), F.lit(1))
    dirs = F.regexp_extract_all(body, F.lit(r'"?[\w.]+"?\s*:\s*"?(-?\w+)'), F.lit(1))
    fields = F.array_join(F.zip_with(names, dirs, lambda n, d: F.concat(n, F.lit(":"), d)), ",")
    return lines.select(F.regexp_extract("line", r"db\.(\w+)\.createIndex", 1).alias("collection"), "index_name", fields.alias("fields"), F.col("line").rlike(r"unique:\s*true").alias("unique"))
