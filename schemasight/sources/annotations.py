"""Index declarations in annotated Java classes, read in one pass over the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemasight.functions.text import lower_first

#: So many characters behind an annotation its field may stand.
RANGE = 500
#: Field annotations: kind, and the direction that its index has.
KINDS = {"Indexed": ("single", "1"), "TextIndexed": ("text", "text"), "GeoSpatialIndexed": ("geo", "1"), "HashIndexed": ("hashed", "hashed"), "WildcardIndexed": ("wildcard", "1")}
COMPOUND, WRAPPER = "CompoundIndex", "CompoundIndexes"
# What the reader stops at: text blocks, strings and characters of one line, comments, annotations, brackets. No two alternatives can start alike and go on
# for long, and quantifiers give nothing back, so every character is looked at a bounded number of times.
_TOKEN = re.compile(r'"""(?s:.*?)"""|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.){1,6}+\'|//[^\n]*+|/\*(?s:.*?)\*/|@\w++|[()]')
_OPENS = re.compile(r"\s*+\(")
_OPTION = re.compile(r"""\b(\w++)\s*+=\s*+("(?:[^"\\\n]|\\.)*+"|'[^'\n]*+'|\w*+)""")
_QUOTED = re.compile(r"""\s*+(["'])(\w++)\1\s*+""")
_NUMBER = re.compile(r"\s*+(-?+\d++)")
_RUN = re.compile(r"([\w<>,\s]*+)(.|$)", re.DOTALL)


@dataclass
class Annotation:
    """An annotation: where it starts and ends, whether a wrapper holds it, and the text between its brackets (None: they don't close)."""

    name: str
    start: int
    end: int
    inside: bool = False
    body: str | None = ""
    options: dict[str, str] = field(default_factory=dict)

    def switched_on(self, option: str) -> bool:
        return self.options.get(option, "").lower() == "true"


def annotations_in(source: str) -> list[Annotation]:
    """The annotations of a text by their start. Brackets in strings and comments don't count; annotations in comments do, each comment by itself."""
    out: list[Annotation] = []
    todo = [(source, 0)]
    while todo:
        text, offset = todo.pop()
        stack: list[Annotation | None] = []
        wrappers, opening = 0, None
        for m in _TOKEN.finditer(text):
            token = m[0]
            if token[0] == "@":
                opening = Annotation(token[1:], offset + m.start(), offset + m.end(), wrappers > 0)
                out.append(opening)
                if _OPENS.match(text, m.end()):
                    continue
            elif token == "(":
                stack.append(opening)
                if opening:
                    opening.body = None
                    wrappers += opening.name == WRAPPER
            elif token == ")" and stack:
                closed = stack.pop()
                if closed:
                    closed.end, wrappers = offset + m.end(), wrappers - (closed.name == WRAPPER)
                    inner = source[closed.start + len(closed.name) + 1 : closed.end - 1]
                    closed.body = inner[inner.index("(") + 1 :]
            elif token[0] == "/":
                todo.append((token[2:], offset + m.start() + 2))
            opening = None
    for a in out:
        if a.name != WRAPPER and a.body:
            a.options = {name: value[1:-1] if value[:1] in ("'", '"') else value for name, value in reversed(_OPTION.findall(a.body))}
    return sorted(out, key=lambda a: a.start)


def field_behind(source: str, end: int) -> str | None:
    """The first field declared within RANGE characters behind ``end``: the last word of a run of types and names that a semicolon or an equals sign ends."""
    for run, stop in _RUN.findall(source[end : end + RANGE]):
        if stop not in (";", "="):
            continue
        run = run.rstrip()
        k = len(run)
        while k and (run[k - 1].isalnum() or run[k - 1] == "_"):
            k -= 1
        if 2 <= k < len(run) and run[k - 1].isspace():
            return run[k:]
    return None


def defined_fields(definition: str) -> dict[str, int]:
    """Names and directions of a compound's definition: quoted names with whole numbers."""
    out = {}
    for entry in definition.strip().strip("{}").split(","):
        name, _, value = entry.partition(":")
        name, value = _QUOTED.fullmatch(name), _NUMBER.match(value)
        if name and value:
            out[name[2]] = int(value[1])
    return out


def declared_in(source: str) -> list[tuple]:
    """(kind, fields as name:direction, name, unique, sparse, ttl, line, error) of a class: compound indexes first, then those of its fields."""
    compounds, singles = [], []
    at, line = 0, 1
    for a in annotations_in(source):
        if a.name != COMPOUND and a.name not in KINDS:
            continue
        line += source.count("\n", at, a.start)
        at = a.start
        if a.body is None:
            singles.append((None, None, None, False, False, None, line, f"@{a.name}: its brackets do not close"))
            continue
        flags = a.switched_on("unique"), a.switched_on("sparse")
        if a.name == COMPOUND:
            fields = defined_fields(a.options.get("def", ""))
            wrong = [f"direction {d} of field {n}" for n, d in fields.items() if d not in (1, -1)]
            shown = ",".join(f"{n}:{d}" for n, d in fields.items())
            if fields:
                compounds.append(("compound", shown, a.options.get("name") or None, *flags, None, line, f"@{a.name}: {', '.join(wrong)}" if wrong else None))
        elif name := field_behind(source, a.end):
            kind, direction = KINDS[a.name]
            ttl = a.options.get("expireAfterSeconds", "")
            singles.append((kind, f"{name}:{direction}", None, *flags, int(ttl) if ttl.isdecimal() else None, line, None))
    return compounds + singles


def standalone(found: DataFrame) -> DataFrame:
    """(path, start) of the compound annotations of (path, content) that no @CompoundIndexes holds."""

    @F.pandas_udf("array<int>")
    def of(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: [a.start for a in annotations_in(s or "") if a.name == COMPOUND and not a.inside])

    return found.select("path", F.explode(of(F.col("content"))).alias("start"))


def next_fields(found: DataFrame) -> DataFrame:
    """(path, nth, field) of each @Indexed annotation of (path, content): the first field declared within RANGE characters behind it, null if none is."""

    @F.pandas_udf("array<string>")
    def of(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: [field_behind(s, a.end) for a in annotations_in(s or "") if a.name == "Indexed"])

    return found.select("path", F.posexplode(of(F.col("content"))).alias("nth", "field"))


def _all_declared(found: DataFrame) -> DataFrame:
    """What ``declared_in`` says of every class of (path, content) that is a document, errors too."""
    kind = "array<struct<kind: string, fields: string, name: string, unique: boolean, sparse: boolean, ttl: int, line: int, error: string>>"

    @F.pandas_udf(kind)
    def of(sources: pd.Series) -> pd.Series:
        names = ("kind", "fields", "name", "unique", "sparse", "ttl", "line", "error")
        return sources.map(lambda s: [dict(zip(names, x, strict=True)) for x in declared_in(s or "")])

    given = F.regexp_extract("content", r"""@Document\s*\(\s*(?:(?:collection|value)\s*=\s*)?["']([^"']+)["']\s*\)""", 1)
    behind = F.substr("content", F.nullif(F.regexp_instr("content", F.lit(r"@Document\b")), F.lit(0)))
    bare = F.regexp_extract(behind, r"\bclass\s+(\w+)", 1)
    collection = F.coalesce(F.nullif(given, F.lit("")), F.nullif(lower_first(bare), F.lit("")))
    rows = found.withColumn("collection", collection).where("collection is not null")
    return rows.select("path", "collection", F.posexplode(of(F.col("content"))).alias("pos", "d")).select("collection", "d.*", "path", F.struct("path", "pos").alias("seq"))


def declared(found: DataFrame) -> DataFrame:
    """(collection, kind, fields, name, unique, sparse, ttl, path, seq) of all annotated classes of (path, content).

    A class without @Document declares nothing. Annotations that can't be read are left out here and listed by ``misdeclared``; the
    others of their class stay.
    """
    return _all_declared(found).where("error is null").drop("line", "error")


def misdeclared(found: DataFrame) -> DataFrame:
    """(path, error) of the annotations of (path, content) that can't be read: directions other than 1 and -1, brackets that don't close."""
    return _all_declared(found).where("error is not null").select("path", F.format_string("%s:%d: %s", "path", "line", "error").alias("error"))


def with_constants(indexes: DataFrame, constants: DataFrame) -> DataFrame:
    """``indexes`` (as ``declared`` gives them) with the values of ``constants`` (name, value) for fields that bear a constant's name.

    Names that come twice in an index by that stand where the first stood, with the direction of the last.
    Every row is put together again from its own parts. Indexes are read once and stand left of the only join, so they are never sent to the driver,
    however small Spark takes texts and lists to be that it has not seen yet.
    """
    parts = indexes.select("*", F.posexplode_outer(F.split("fields", ",")).alias("_pos", "_part"))
    named = parts.select(*indexes.columns, "_pos", F.regexp_extract("_part", "^([^:]*)", 1).alias("_name"), F.regexp_extract("_part", ":(.*)$", 1).alias("_direction"))
    known = constants.select(F.col("name").alias("_name"), F.col("value").alias("_value"), F.lit(True).alias("_known"))
    part = F.struct("_pos", F.coalesce("_value", "_name").alias("name"), F.col("_direction").alias("direction"))
    rows = named.join(known, "_name", "left").groupBy(indexes.columns).agg(F.count("_known").alias("_hits"), F.count("*").alias("_n"), F.array_sort(F.collect_set(part)).alias("_parts"))
    last = lambda name: F.element_at(F.filter("_parts", lambda p: p["name"] == name), -1)["direction"]
    names = F.array_distinct(F.transform("_parts", lambda p: p["name"]))
    shown = F.array_join(F.transform(names, lambda n: F.concat_ws(":", n, last(n))), ",")
    # rows that are alike in every column were counted as one
    alike = F.sequence(F.lit(1), (F.col("_n") / F.size("_parts")).cast("int"))
    rows = rows.withColumn("fields", F.when(F.col("_hits") > 0, shown).otherwise(F.col("fields")))
    return rows.select(*indexes.columns, F.explode(alike).alias("_nth")).select(indexes.columns)
