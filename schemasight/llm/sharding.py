"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, running_before, settle, table


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; all keys jump side by side until none lands below ``shards``."""
    keys = keys.astype("uint64")
    shard = np.zeros(len(keys), "int64")
    to = np.zeros(len(keys), "int64")
    live = np.arange(len(keys))
    while len(live):
        shard[live] = to[live]
        keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
        steps = float(1 << 31) / ((keys[live] >> np.uint64(33)).astype("float64") + 1.0)
        to[live] = ((shard[live] + 1) * steps).astype("int64")
        live = live[to[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a long key, as a column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy("int64"), shards), dtype="int32")

    return of(key)


def shard_key(df: DataFrame, name: str) -> Column:
    """Integers are their own key; other values and null count by their 64-bit hash."""
    col = F.col(name)
    return F.coalesce(col.cast("long") if dict(df.dtypes)[name] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(col.cast("string")), F.xxhash64(F.lit(None).cast("string")))


def shard_documents(df: DataFrame, key: str, shards: int, order: list[str], grown: bool = False) -> DataFrame:
    """Add shard and slot to every row, and grown_shard (with one shard more) if asked.

    The key and the number of shards alone decide the shard; of ``shards`` + 1 shards only the last
    takes rows from others. ``df`` is read several times, so give a table or a settled one. Slots number the
    rows of a shard from 0 without gaps, in the order of a digest of ``key`` and ``order`` (columns
    that tell rows apart), by ranges of the digest, so that no shard passes through one task.
    Columns shard, slot and grown_shard of the input are replaced. A null key has the shard
    of its hash; rows with equal keys share a shard; equal rows get different slots; an empty
    table gives an empty one.
    """
    df = df.drop("shard", "slot", "grown_shard")
    at = shard_key(df, key)
    out = df.withColumn("shard", shard_of(at, shards))
    if grown:
        out = out.withColumn("grown_shard", shard_of(at, shards + 1))
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key, *order)]))
    own = fresh(out.columns, "_digest")
    return running_before(out.withColumn(own, digest), "shard", [own], F.lit(1).cast("long"), "slot", F.conv(F.substring(own, 1, 6), 16, 10).cast("long")).drop(own)


def shard_in_order(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add shard and slot to every row of a table in Parquet files; slots follow the order in which the rows stand there.

    Files count in the order of their names, as Spark writes a sorted table. Each (shard, file) is numbered by itself and starts
    after the shard's earlier files, whose counts (a row for each shard and file) are all that a window over a shard sees. Columns
    shard and slot are replaced; equal rows get different slots; a table that is read from no Parquet files is settled
    first, in its own order.
    """
    df = df.drop("shard", "slot")
    names = list(df.columns)
    row, file, start, within = (fresh(names, f"_{x}") for x in ("row", "file", "start", "within"))
    out = numbered(df.withColumn("shard", shard_of(shard_key(df, key), shards)), row).withColumn(file, F.col(f"{row}.file"))
    counts = out.groupBy("shard", file).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    place = F.row_number().over(Window.partitionBy("shard", file).orderBy(f"{row}.row")) - 1
    out = out.withColumn(within, place).join(starts, ["shard", file])
    return out.select(*names, "shard", (F.col(start) + F.col(within)).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir):
    """All documents in 16 shards by doc_id; size: UTF-8 bytes plus 1."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_documents(settle(docs), "doc_id", 16, ["text_crc32", "size"], grown=True)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP1_SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT b AS byte, CAST(b AS UBIGINT) AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM polynomial WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM polynomial WHERE k = 8
), docs AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
), summed AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_transform(bytes, lambda h: CAST(('0x' || h) AS UBIGINT)), lambda a, b: xor(a >> 8, crc.t[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM docs, crc
), jumps AS (
  SELECT doc_id, n, CAST(doc_id AS HUGEINT) AS k, 0::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(k // 8589934592 AS DOUBLE) + 1.0::DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE j < n)
), placed AS (
  SELECT doc_id, CAST(max(b) FILTER (WHERE n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE n = 17) AS INTEGER) AS grown_shard FROM jumps WHERE j >= n GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || '|' || text_crc32 || '|' || size)) - 1 AS BIGINT) AS slot
FROM summed JOIN placed USING (doc_id)
"""
