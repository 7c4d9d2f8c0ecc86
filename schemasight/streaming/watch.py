"""Incremental scans: files that arrive are matched against the rules as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight.functions.text import split_lines
from schemasight.operators.rules import code_rules


def incoming(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """New files below ``root`` as a stream of (file_id, arrived, line_no, text)."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).format("text").load(root)
    found = raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode(split_lines(F.col("value"))).alias("pos", "text"))
    return found.select("file_id", "arrived", (F.col("pos") + 1).alias("line_no"), "text")


def watched(stream: DataFrame) -> DataFrame:
    """Violations of the application-code rules on a stream of lines; stateless, so append mode holds."""
    return code_rules(stream)


def hourly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Lines scanned by hour of arrival, with a watermark for late files."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour").alias("hour")).agg(F.count("*").alias("lines"))
