"""Near-duplicates by the exact similarity of their shingles, with candidates from SimHash and, for what differs in more bits, banded minima (Broder, 1997).

Two texts are linked if the Jaccard similarity of their sets of word shingles is ``LEAST`` or more. First the SimHash
fingerprints of the sets are searched by pigeonring (see ``simhash``); those within its few bits are confirmed on the sets, and what such links
connect is one group from then on. Similar sets may differ in more bits than any filter on segments tells from chance, so the groups are then searched for
further links: of each set the minima under ``BANDS`` x ``ROWS`` hash functions are taken; texts that agree on a whole band are
candidates, and each is confirmed on the sets themselves. A pair at 0.8 shares no band with a probability
of (1 - 0.8^4)^40 = 7e-10, one above it with less. Equal sets are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, settle, text_batches

WORDS, BANDS, ROWS = 5, 40, 4
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Groups up to FEW become pairs; larger ones are searched in a task each, and beyond MOST sets or HELD hashes in a task for each two blocks.
FEW, MOST, HELD = 16, 1 << 12, 1 << 20
_RANDOM = np.random.default_rng(5)
FACTORS, MASKS = (_RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), "uint64") * np.uint64(2) + np.uint64(1) for _ in range(2))
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of all runs of ``words`` words; a shorter text is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, "uint64")
    grams = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, grams)), "uint64"))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of minima."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, "uint64")
    for k in range(0, len(hashes), 1 << 10):
        np.minimum(least, ((hashes[k : k + (1 << 10)] ^ MASKS) * FACTORS).min(1), out=least)
    out = np.arange(BANDS, dtype="uint64")
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(32)
    return out


def sketch(text: Column) -> Column:
    """struct(sig, size, fp, bands): a hash of the set of shingles, its size, its fingerprint, its bands."""

    @F.pandas_udf("struct<sig: long, size: long, fp: long, bands: array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            found = shingles(x)
            sig = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view("int64")
            rows.append((sig, len(found), simhash.signed(simhash.folded(found.astype("<u8"))), bands(found).view("int64") if len(found) else np.zeros(0, "int64")))
        return pd.DataFrame(rows, columns=["sig", "size", "fp", "bands"])

    return of(text.cast("binary"))


def hashed(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).view("int64") for x in texts])

    return of(text.cast("binary"))


def alike(shared, x, y):
    """Whether sets of sizes x and y that share so many are similar enough."""
    return LEAST[1] * shared >= LEAST[0] * (x + y - shared)


def linked(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join all members of a group that chains of similar sets connect: a search from each member
    not yet reached over those not yet reached, so that dense groups need few comparisons."""
    sigs, sets = group["sig"].to_numpy("int64"), group["hashes"].tolist()
    sizes = np.array([len(x) for x in sets])
    # sets of one size after the other, so that a search looks only at sizes that can be similar
    order = np.argsort(sizes, kind="stable")
    sigs, sizes = sigs[order], sizes[order]
    _, words = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    mark, rest, out = np.zeros(words.max() + 1, bool), np.ones(len(sigs), bool), []
    for first in range(len(sigs)):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front and rest.any():
            f = front.pop()
            own = words[ends[f] - sizes[f] : ends[f]]
            lo, hi = np.searchsorted(sizes, -(-LEAST[0] * sizes[f] // LEAST[1])), np.searchsorted(sizes, LEAST[1] * sizes[f] // LEAST[0], "right")
            mark[own] = True
            start = ends[lo] - sizes[lo]
            shared = np.add.reduceat(mark[words[start : ends[hi - 1]]], ends[lo:hi] - sizes[lo:hi] - start, dtype="int64")
            mark[own] = False
            near = lo + np.flatnonzero(rest[lo:hi] & alike(shared, sizes[f], sizes[lo:hi]))
            rest[near] = False
            front += near.tolist()
            out.append(np.stack([np.full(len(near), sigs[f]), sigs[near]]))
    a, b = np.concatenate(out, 1) if out else (np.zeros(0, "int64"),) * 2
    return pd.DataFrame({"a": a, "b": b})


def confirmed(x: Column, y: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    return of(x, y)


def possible(pairs: DataFrame) -> DataFrame:
    """Different pairs (a, b) of classes, of those (a, b) as struct(sig, size) whose sizes can be similar."""
    pairs = pairs.where((F.col("a.sig") != F.col("b.sig")) & (LEAST[1] * F.least("a.size", "b.size") >= LEAST[0] * F.greatest("a.size", "b.size")))
    return settle(pairs.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b")).distinct())


def sets_of(sigs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(sig, hashes): the sets of the classes asked for, in a settled table."""
    reps = rows.groupBy("sig").agg(F.min("key").alias("key")).join(sigs.distinct(), "sig", "left_semi")
    return settle(texts.join(reps, "key").select("sig", hashed(F.col("text")).alias("hashes")))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(confirmed(F.col("x"), F.col("y"))).select("a", "b")


def close_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between similar classes whose fingerprints are equal or joined by pigeonring within its bits, in a settled table. rows has (key, sig, size, fp)."""
    classes = settle(rows.where("size > 0").groupBy("sig").agg(F.first("size").alias("size"), F.first("fp").alias("fp")))
    heads = settle(classes.groupBy("fp").agg(F.min(F.struct("sig", "size")).alias("a")))
    same = classes.join(heads, "fp").select("a", F.struct("sig", "size").alias("b"))
    near = simhash.links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    pairs = possible(same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    sets = sets_of(ends(pairs), rows, texts)
    found = settle(checked(pairs, sets))
    for done in (classes, heads, pairs, sets):
        discard(done)
    return found


def links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect all similar ones, in a settled table. rows has (key, sig, size, fp, bands), texts (key, text)."""
    close = close_links(rows, texts)
    groups = settle(components(close))
    # group: what links of fingerprints connect already
    filed = rows.select("sig", "size", "bands").where("size > 0").dropDuplicates(["sig"]).join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    filed = settle(filed.select("sig", "size", F.coalesce("component", "sig").alias("group"), F.explode("bands").alias("band")))
    discard(groups)
    one = F.struct("sig", "size", "group")
    # bands within one group have nothing to add
    groups = filed.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min(one).alias("a"), F.max(one).alias("b"), F.bit_xor(F.xxhash64("sig")).alias("members"), F.min("group").alias("first"), F.max("group").alias("last"))
    groups = groups.where("n > 1 and first <> last")
    # the same members under several bands: once
    groups = settle(groups.groupBy("n", "hashes", "a", "b", "members").agg(F.min("band").alias("band")))
    few = filed.join(groups.where(F.col("n").between(3, FEW)).select("band"), "band").select("band", one.alias("a"))
    pairs = groups.where("n = 2").select("a", "b").unionByName(few.join(few.withColumnRenamed("a", "b"), "band").where("a.sig < b.sig").select("a", "b"))
    pairs = possible(pairs.where("a.group <> b.group"))
    blocks = F.ceil(F.greatest(F.col("n") / MOST, F.col("hashes") / HELD)).cast("int")
    large = filed.join(groups.where(F.col("n") > FEW).select("band", blocks.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    large = large.select("band", "sig", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = settle(large.select("band", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    sets = sets_of(ends(pairs).union(large.select("sig")), rows, texts)
    found = checked(pairs, sets).unionByName(large.join(sets, "sig").groupBy("band", "i", "j").applyInPandas(linked, "a long, b long"))
    # settled before it is contracted: a task then has one Python worker at a time
    found = settle(found.unionByName(close))
    for done in (close, filed, groups, pairs, large, sets):
        discard(done)
    return found


def near_copies(df: DataFrame) -> DataFrame:
    """(key, root): one row per row of ``df`` (key, text); rows that links connect share root.

    key tells every row from all others and can be ordered. Texts without words are copies of each other. An empty table gives an
    empty one. Very long texts count with all their shingles. Other columns are not read, whatever they are called.
    """
    text_batches(df.sparkSession)
    rows = settle(df.select("key", sketch(F.col("text")).alias("s")).select("key", "s.*"))
    found = links(rows, df)
    roots = settle(components(found))
    out = settle(rows.select("key", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", F.coalesce("component", "sig").alias("root")))
    for done in (found, roots, rows):
        discard(done)
    return out
