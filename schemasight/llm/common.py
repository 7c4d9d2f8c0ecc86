"""What several operators share: reading tables, settled intermediate tables,
running totals without one task per group, and connected components."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemasight.shared import discard, settle, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Send whole texts to Python a thousand rows at a time, unless the session says otherwise: ten thousand, the
    default, are made for short rows, and a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def hand_back() -> None:
    """Give freed memory of this Python worker back to the machine: large arrays leave holes that the allocators keep otherwise, and the
    other workers and the JVM of the executor share its limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(taken: list[str], name: str = "_own") -> str:
    """A column name that is not taken, for columns of our own beside those of a user's table."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add column ``name``: what tells every row from all others, also from equal ones: its place in the Parquet files that ``df`` reads,
    struct(file, row). Other tables are settled first. The place stays the same however often the files are read."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(name, place)
    except AnalysisException:
        return settle(df).withColumn(name, place)


def lower_az(col):
    """A-Z lower-cased, nothing else; texts of ASCII alone take the faster ``lower``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def running_before(df: DataFrame, group: str, order: list[str], weight, name: str, spread=None, per_bucket: int = 1 << 13) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (a long) over the rows of the same ``group`` that come earlier.

    Rows are ordered by ``spread`` (evenly spread longs of 24 bits; by default a hash of ``order``),
    then by ``order``; each (group, range of ``spread``) is one window, and the totals of earlier buckets are added from a small table. So a group that
    holds most rows is spread like the others. ``group`` must not be null. Rows equal in all of
    ``order`` come in any order, next to each other. Other columns may have any names.
    """
    bits = max(6, (df.count() // per_bucket).bit_length())
    names = list(df.columns)
    at, bucket, heavy, start, within = (fresh(names, f"_{x}") for x in ("spread", "bucket", "weight", "start", "within"))
    df = df.withColumn(at, F.shiftrightunsigned(F.xxhash64(*order), 40) if spread is None else spread)
    df = df.withColumn(bucket, F.shiftright(at, 24 - bits)).withColumn(heavy, weight)
    keys = [group, bucket]
    rows = Window.partitionBy(*keys).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(heavy).alias("sum"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(start))
    df = df.withColumn(within, F.coalesce(F.sum(heavy).over(rows), F.lit(0)))
    return df.join(sums, keys).select(*names, (F.col(start) + F.col(within)).alias(name))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", copies: int = 32, most: int = 1000) -> DataFrame:
    """``left`` with what ``right``, which has a row a key at most, says of its ``key``. Where it says nothing, there are nulls,
    or no row if ``how`` is inner.

    Keys that more than one in ``most`` rows of ``left`` bear (so at most ``most`` of them; no others pass through the driver) are dealt to ``copies``
    tasks, and their rows of ``right`` copied as often; all others are joined as they are. ``left`` is read three times: settle it before.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    heavy = [r[0] for r in counts.where(F.col("n") > max(total // most, 10_000)).select(key).collect()]
    if not heavy:
        return left.join(right, key, how)
    salt = fresh([*left.columns, *right.columns], "_salt")
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    dealt = left.where(hot).withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(copies)).cast("int"))
    copied = right.where(hot).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return left.where(~hot).join(right, key, how).unionByName(dealt.join(copied, [key, salt], how).drop(salt))


def _forest(batches):
    """Union-find over the links of one partition: each node with the least one it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def flush():
        nodes = np.fromiter(parent, "int64", len(parent))
        roots = np.fromiter((find(int(x)) for x in nodes), "int64", len(nodes))
        keep = nodes != roots
        return pd.DataFrame({"a": nodes[keep], "b": roots[keep]})

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                parent.setdefault(a, a)
        if len(parent) > 1_000_000:  # bounded memory: hand on what is known and start anew
            yield flush()
            parent.clear()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (node, component) for each node that
    has a link to another one; component is the least node it reaches.

    Alternating large-star and small-star rounds on the links, each settled in the shared folder;
    before the first, every partition contracts its own links, which removes most of them.
    """
    now = settle(links.where("a <> b").mapInPandas(_forest, "a long, b long").distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        after = settle(small)
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if mark == last or not mark[0]:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
        last = mark
