"""Reports: JSON by Spark's writer, and HTML pages of the violations of a project or of each service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemasight.functions.text import escape_html, safe_name
from schemasight.pages import Pages
from schemasight.registry import CATEGORY_ORDER
from schemasight.sources.tree import qualified


def write_json(df: DataFrame, path: str, *by: str) -> None:
    """One JSON object a row, without null fields; with ``by`` in a directory for each value, under a safe name."""
    for name in by:
        df = df.withColumn(name, safe_name(F.col(name)))
    df.write.mode("overwrite").option("ignoreNullFields", True).partitionBy(*by).json(path)


def html_rows(violations: DataFrame, *keep: str) -> DataFrame:
    """(category, ord, html) and what to keep: a table row for each violation, escaped; categories in their fixed order."""
    order = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return violations.select(*keep, "category", order.alias("ord"), F.concat(F.lit("<tr>"), *[cell(c) for c in ("file_id", "line_no", "rule_id", "severity", "action")], F.lit("</tr>")).alias("html"))


def page_rows(violations: DataFrame, gate: DataFrame, page: Column) -> DataFrame:
    """(page, part, section, html) of pages for people: the gate first, then the violations by category. ``page`` names the page of a row of
    either table; a gate without violations has a page too."""
    counts = [c for c in gate.columns if c not in ("passed", "service", "project", "_name")]
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in counts])
    title = escape_html(F.coalesce(F.col("service"), F.lit("all services"))) if "service" in gate.columns else F.lit("Violations")
    head = [F.lit("<!doctype html><meta charset=\"utf-8\"><title>"), title, F.lit("</title><h1>"), title, F.lit(": "), F.when(F.col("passed"), "Passed").otherwise("Blocked"), F.lit("</h1><p>"), shown, F.lit("</p>")]
    out = gate.select(page.alias("page"), F.lit(0).alias("part"), F.lit("").alias("section"), F.concat(*head).alias("html"))
    rows = html_rows(violations.withColumn("_page", page), "_page")
    return out.unionByName(rows.select(F.col("_page").alias("page"), F.col("ord").cast("int").alias("part"), F.col("category").alias("section"), "html"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Write ``page_rows`` below ``path``: each page is sorted and written by one task, a row at a time, and moved to its place when all are there."""
    spark = rows.sparkSession
    spark.dataSource.register(Pages)
    rows.repartition("page").sortWithinPartitions("page", "part", "html").write.format("html_pages").mode("append").save(qualified(spark, path))


def write_page(violations: DataFrame, gate: DataFrame, file: str) -> None:
    """One page of all violations and the gate, in ``file``."""
    folder, _, name = file.rpartition("/")
    write_rows(page_rows(violations, gate, F.lit(name)), folder or ".")


def write_services(violations: DataFrame, gate: DataFrame, path: str) -> None:
    """A page for each service, service_<name>_report.html, and index.html with the gate of all; names that are the same once they are safe bear a
    number that tells them apart. gate is that of each service with one of all (service null)."""
    safe = safe_name(F.col("service"))
    same = gate.where("service is not null").select("service", safe.alias("_safe")).withColumn("_n", F.count("*").over(Window.partitionBy("_safe")))
    number = F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.crc32("service").cast("string"))).otherwise("")
    names = same.select("service", F.concat(F.lit("service_"), "_safe", number, F.lit("_report.html")).alias("_name"))
    found = violations.join(names, "service")
    gates = gate.join(names, "service", "left")
    rows = page_rows(found, gates.where("_name is not null"), F.col("_name"))
    index = page_rows(found, gate.where("service is null"), F.lit("index.html")).where("part = 0")
    link = F.concat(F.lit('<tr><td><a href="'), escape_html(F.col("_name")), F.lit('">'), escape_html(F.col("service")), F.lit("</a></td><td>"), F.when(F.col("passed"), "Passed").otherwise("Blocked"), F.lit("</td><td>"), F.col("total").cast("string"), F.lit("</td></tr>"))
    links = gates.where("_name is not null").select(F.lit("index.html").alias("page"), F.lit(1).alias("part"), F.lit("Services").alias("section"), link.alias("html"))
    write_rows(rows.unionByName(index).unionByName(links), path)


def html_report(violations: DataFrame, gate: DataFrame) -> str:
    """The page of a small project as one text."""
    rows = page_rows(violations, gate, F.lit("")).orderBy("part", "html").collect()
    out, last = [], ""
    for r in rows:
        if r.section != last:
            out.append("</table>" * bool(last) + f"<h2>{r.section}</h2><table>")
            last = r.section
        out.append(r.html)
    return "\n".join([*out, "</table>" * bool(last)])
