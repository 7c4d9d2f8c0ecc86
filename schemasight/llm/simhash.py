"""Near-duplicates by SimHash, with candidates from the pigeonring principle (Qin and Xiao, 2018).

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in 3 bits at most,
then from some segment on every chain of l consecutive segments differs in 3 l / 8 bits at most:
the first two segments are equal, and of the next three at least two. Each fingerprint is therefore
filed under 8 x 3 keys of 32 bits; those that share a key are compared chain by chain against the
budgets, and in full only if they stay within all of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settle, table, text_batches

SEGMENTS, BITS, DIFFER = 8, 8, 3
#: Groups beyond this size are filed under longer keys; after two steps, no group of different fingerprints can be larger.
MOST = 1 << 12


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of the word shingles of a text, repeats included; 0 without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    grams = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    return folded(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, grams)), "<u8"))


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (little-endian)."""
    ones = np.zeros(64, "int64")
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long, of the text's UTF-8 bytes."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words) for x in texts], "uint64").view("int64"))

    return of(text.cast("binary"))


def chain(start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments of the ring."""
    return sum(((1 << BITS) - 1) << BITS * ((start + k) % SEGMENTS) for k in range(length))


def keys() -> list[tuple[int, int]]:
    """(start, mask) of every kind of key: two equal segments, and two of the next three."""
    return [(i, chain(i, 2) | chain(i + a, 1) | chain(i + b, 1)) for i in range(SEGMENTS) for a, b in combinations((2, 3, 4), 2)]


def finer(mask: int) -> list[int]:
    """The masks that split a group further and still lose no pair within ``DIFFER`` bits.

    Of 4 free segments one is equal; of the 6 halves of 3 free segments three are.
    """
    free = [k for k in range(SEGMENTS) if not mask >> BITS * k & 1]
    if len(free) > DIFFER:
        return [mask | chain(k, 1) for k in free]
    halves = [((1 << BITS // 2) - 1) << BITS * k + h for k in free for h in (0, BITS // 2)]
    return [mask | sum(x) for x in combinations(halves, len(halves) - DIFFER)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(start: int, x: np.ndarray) -> np.ndarray:
    """Which differences stay within the budget of every chain from ``start``, and of the whole ring."""
    left = np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        left = left[np.bitwise_count(x[left] & np.uint64(chain(start, length))) <= DIFFER * length // SEGMENTS]
    return left


def linked(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join all members of a group that chains of close fingerprints connect: a search from each
    member not yet reached, so that dense groups need few comparisons and give a link a member."""
    start, rest, out = int(group["start"].iat[0]), np.unique(group["fp"].to_numpy().view("uint64")), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            new = []
            for f in front:
                near = within(start, rest ^ f)
                if len(near):
                    found = rest[near]
                    out.append((np.full(len(found), f), found))
                    new.append(found)
                    rest = np.delete(rest, near)
            front = np.concatenate(new) if new else rest[:0]
    a, b = (np.concatenate(x).view("int64") for x in zip(*out, strict=True)) if out else (np.zeros(0, "int64"),) * 2
    return pd.DataFrame({"a": a, "b": b})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, no repeats) that connect all within ``DIFFER`` bits.

    Groups of one need nothing, groups of two are compared in place, larger ones in a task each; a
    group of more than ``MOST`` is filed anew under longer keys instead. No pair is skipped.
    """
    filed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in keys()])).alias("x"), "fp").select("x.*", "fp")
    out, by = None, ["start", "mask", "key"]
    for most in (MOST, MOST, 1 << SEGMENTS * BITS - 52):
        sizes = settle(filed.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        pairs = sizes.where("n = 2").select("start", "a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("x"))
        for length in range(1, SEGMENTS + 1):
            masks = F.array(*[F.lit(signed(chain(i, length))) for i in range(SEGMENTS)])
            pairs = pairs.where(F.bit_count(F.col("x").bitwiseAND(F.get(masks, F.col("start")))) <= DIFFER * length // SEGMENTS)
        groups = filed.join(sizes.where(F.col("n").between(3, most)).select(by), by, "left_semi").groupBy(*by).applyInPandas(linked, "a long, b long")
        found = pairs.select("a", "b").unionByName(groups)
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("n") > most).select(by)
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # a few hundred kinds of keys at most
        if not masks:
            break
        step = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(signed(y)) for y in finer(m % (1 << 64))]))])
        more = filed.join(large, by, "left_semi").select("start", F.explode(step[F.col("mask")]).alias("mask"), "fp")
        filed = settle(more.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, root): one row per row of ``df``; rows whose fingerprints links connect share component_id.

    component_id is the least id of the component, root its least fingerprint. Equal fingerprints
    are one class throughout, so copies are never compared with each other. Texts without words
    (null, empty, blank) have fingerprint 0 and are near-duplicates of each other. Null ids keep a row and count
    only where a component has no other. An empty table gives an empty one. Very long texts are hashed whole, 32,768 shingles of them at
    a time, and all shingles weigh alike. Other columns are not returned and may have any names.

    For links by the similarity of shingles instead of by bits see ``shingles.near_copies``: of two texts that share
    four fifths of their shingles, fingerprints of 64 bits differ in 10 or more, which no filter on segments can tell from chance.
    """
    text_batches(df.sparkSession)
    rows = settle(df.select(F.col(id_col).alias("id"), simhash(F.col(text_col), words).alias("fp")))
    classes = settle(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp")))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    classes = settle(classes)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(classes.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op2_simhash(spark, sf_dir):
    """Near-duplicates of all documents: fingerprints within 3 bits, joined into components."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
