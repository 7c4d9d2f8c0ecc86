"""The sections of reports: counts, summaries and heads of lists, each one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(rows: DataFrame, *statuses: str) -> DataFrame:
    """One row: how many of ``rows`` (status) are in each status, and in all."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row of a comparison of scripts and code (status both, script_only, code_only): script_total, code_total, covered, extra, missing."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return compared.agg(n("both", "script_only").alias("script_total"), n("both", "code_only").alias("code_total"), n("both").alias("covered"), n("script_only").alias("extra_in_script"), n("code_only").alias("missing_from_script"))


def top(suggestions: DataFrame, n: int = 10) -> DataFrame:
    """The first suggestions of a report: by priority, references and name; a top-k, so nothing is sorted as a whole."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return suggestions.orderBy(rank, F.desc("refs"), "collection", "field").limit(n)


def scan_summary(indexes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(section, name, n): indexes and suggestions of a scan, in all, by kind and by priority."""
    total = lambda df, name: df.agg(F.lit("total").alias("section"), F.lit(name).alias("name"), F.count("*").alias("n"))
    each = lambda df, section, c: df.groupBy(F.lit(section).alias("section"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return total(indexes, "indexes").unionByName(total(suggestions, "suggestions")).unionByName(each(indexes, "by_type", "kind")).unionByName(each(suggestions, "by_priority", "priority"))


def line_report(found: DataFrame) -> DataFrame:
    """(section, name, n) of index lines (file_id, type): by_type, by_file and all, in one pass."""
    sets = found.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), c.alias("name")) for s, c in (("by_type", F.col("type")), ("by_file", F.col("file_id").cast("string")), ("all", F.lit("lines")))])).alias("x"))
    return sets.groupBy("x.section", "x.name").agg(F.count("*").alias("n"))


def gate_report(project: str, violations: DataFrame, gate: DataFrame, errors: DataFrame, files: DataFrame) -> DataFrame:
    """A JSON line for each part of a report: project, gate_decision, summary (files by category), a violation or an error each; section says which."""
    row = lambda section, df, *columns: df.select(F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("json"))
    known = [c for c in ("rule_id", "category", "severity", "action", "file_id", "line_no", "text") if c in violations.columns]
    counts = files.agg(F.count("*").alias("files_scanned"), F.count_if(F.col("path").endswith(".sql")).alias("migration_files_scanned"), F.count_if(F.col("path").endswith(".java")).alias("java_files_scanned"))
    decision = gate.select("passed", F.col("total").alias("total_violations"), F.col("critical").alias("critical_count"), F.col("high").alias("high_count"), F.col("medium").alias("medium_count"))
    out = row("gate_decision", decision, *decision.columns).unionByName(row("summary", counts.withColumn("project_path", F.lit(project)), "project_path", *counts.columns))
    return out.unionByName(row("violations", violations, *known)).unionByName(row("errors", errors, *errors.columns))


def first_errors(errors: DataFrame, n: int = 5, *by: str) -> DataFrame:
    """The first ``n`` errors (error, ...) of each group with more: how many further ones there are."""
    group = Window.partitionBy(*by)
    found = errors.withColumn("nth", F.row_number().over(group.orderBy("error"))).withColumn("_all", F.count("*").over(group))
    return found.where(F.col("nth") <= n).withColumn("more", F.greatest(F.lit(0), F.col("_all") - n).cast("long")).drop("_all")


#: A cell of a printed table is cut to this many characters.
WIDEST = 40


def table_lines(rows: DataFrame, widths: dict[str, int], mark: str = "") -> DataFrame:
    """The rows with table_line: the columns of ``widths`` side by side, padded to their widths and cut there; line ends and tabs become blanks, nulls are empty."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\n\r\t]", " ")
    cells = [F.rpad(shortened(flat(c), w - len(mark), mark), w, " ") for c, w in widths.items()]
    return rows.withColumn("table_line", F.rtrim(F.concat_ws("  ", *cells)))


def fitting_widths(rows: DataFrame) -> dict[str, int]:
    """The width of each column: that of its longest cell or name, ``WIDEST`` at most. One pass that gives one row."""
    longest = rows.select([F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for c in rows.columns]).first()
    return {c: min(WIDEST, max(len(c), longest[c])) for c in rows.columns}


def shortened(text: Column, most: int, mark: str = "") -> Column:
    """A text cut to ``most`` characters, with a mark if something is lost."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)
