"""Line dedup: lines that many documents share are dropped everywhere. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_az, settle, table

SPACE = " \t\n\x0b\f\r"


def line_hashes(text: Column) -> Column:
    """For each line two 64-bit hashes of its key (blanks stripped at both ends, A-Z lower-cased), null for an empty key."""

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))

    return F.transform(F.split(lower_az(text), "\n", -1), hashed)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Add n_lines, n_dropped and kept_text: the text without lines whose key is in at least ``min_docs`` rows.

    Keys are counted once per row, with partial sums before the shuffle, so a line that is in every
    row is no heavier than others. The rows are then joined to the positions they lose by id and
    hash of the text; equal rows lose equal lines. A document is a row: each counts for itself, also
    with a null or repeated id. A null or empty text is one empty line, and empty keys are never
    dropped; kept_text is then ''. Columns of these three names are replaced.
    """
    df = df.drop("n_lines", "n_dropped", "kept_text")
    own, pieces, gone = (fresh(df.columns, f"_{x}") for x in ("key", "lines", "lost"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(id_col).isNull().alias("n"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    hashes = df.select(key.alias("_key"), line_hashes(text).alias("lines"))
    common = hashes.select(F.explode(F.array_distinct("lines")).alias("l")).where("l is not null").groupBy("l.h", "l.g").count().where(F.col("count") >= min_docs).select("h", "g")
    common = settle(common)  # else its grouping would be reused for the join, and a line of all documents meet in one task
    lines = hashes.select("_key", F.posexplode("lines").alias("pos", "l")).where("l is not null").select("_key", "pos", "l.h", "l.g")
    lost = lines.join(common, ["h", "g"], "left_semi").groupBy(F.col("_key").alias(own)).agg(F.collect_set("pos").alias(gone))
    out = df.withColumn(own, key).join(lost, own, "left").withColumn(pieces, F.split(text, "\n", -1))
    out = out.withColumn("n_lines", F.size(pieces).cast("long")).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    joined = F.concat_ws("\n", F.transform(kept, lambda i: F.get(pieces, i)))
    return out.withColumn("kept_text", F.when(F.col(gone).isNull(), text).otherwise(joined)).drop(own, pieces, gone)


def op6_line_dedup(spark, sf_dir):
    """Lines that at least 10 documents share, dropped from all documents."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT row, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY row, doc_id
"""
