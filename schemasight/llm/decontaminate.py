"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Texts are compared by k-grams of words. Of every ``WINDOW`` - k + 1 consecutive k-gram hashes the least is
kept, so two texts that share ``WINDOW`` words keep at least one hash there in common. Documents that keep a hash of some
item are read again, once each: a shared hash is extended to all windows that hold its words, and these are looked up among the
windows of the items by 128 bits, which decides. Items too short for a window are looked up whole. So a k-gram that
many documents and items share makes no pairs of them; only windows do, where the result names the items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, table, text_batches

WINDOW, GRAM = 13, 5
#: Up to so many fingerprints of items are sent to the tasks, to leave out at once what meets none of them; beyond, the join alone decides.
SIEVE = 1 << 20
#: Bytes that are not part of words become blanks, A-Z become a-z; bytes of other characters stay.
BYTES = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in bytes(range(256)).lower())


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(BYTES).split()


class Hashes(dict):
    """Word to 64-bit hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0]
    out = np.full(n, k, "uint64")
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def winnow(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) kept: the least of each window, the leftmost of equal ones."""
    found = grams(words, GRAM)
    if len(words) < WINDOW:
        return found[:0], np.zeros(0, "int64")
    windows = np.lib.stride_tricks.sliding_window_view(found, WINDOW - GRAM + 1)
    places = np.unique(windows.argmin(1) + np.arange(len(windows)))
    return found[places], places


def prints(text: Column, short: list[int], whole: bool, sieve=None) -> Column:
    """struct(n_words, hashes, places, lengths). short: lengths at which all runs of words are hashed too, or with ``whole``
    only a text that is just so long; lengths is 0 for the k-grams kept. sieve: a broadcast of the sorted hashes that matter."""

    @F.pandas_udf("struct<n_words: long, hashes: array<long>, places: array<int>, lengths: array<int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        cache, rows = Hashes(), []
        for x in texts:
            words = words_of(x)
            ids = np.fromiter(map(cache.__getitem__, words), "uint64", len(words))
            parts = [(*winnow(ids), 0)]
            for k in short:
                if len(ids) == k or not whole and len(ids) > k:
                    parts.append((found := grams(ids, k), np.arange(len(found)), k))
            hashes, places = (np.concatenate(p) for p in zip(*(p[:2] for p in parts), strict=True))
            lengths = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
            if sieve is not None and len(hashes):
                known = sieve.value
                at = np.searchsorted(known, hashes)
                keep = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
                hashes, places, lengths = hashes[keep], places[keep], lengths[keep]
            rows.append((len(words), hashes.view("int64"), places.astype("int32"), lengths.astype("int32")))
        return pd.DataFrame(rows, columns=["n_words", "hashes", "places", "lengths"])

    return of(text.cast("binary"))


def window_hashes(words: list[bytes], cache: Hashes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of ``k`` words."""
    ids = np.fromiter(map(cache.__getitem__, words), "uint64", len(words))
    return grams(ids, k), grams(ids ^ np.uint64(0xA5A5A5A5A5A5A5A5), k)


WINDOWS = "array<struct<h: long, g: long, start: int, k: int>>"


def windows_of(words: list[bytes], cache: Hashes, hits) -> list[dict]:
    """The runs of words (h, g, start, k) to look up: for each hit (place, k) the run of k words there, or, for k = 0, all
    windows around the k-gram at that place."""
    out, seen = [], {}
    for place, k in hits:
        n = k or WINDOW
        first, last = (place, place) if k else (max(0, place + GRAM - WINDOW), min(place, len(words) - WINDOW))
        seen.setdefault(n, set()).update(range(first, last + 1))
    for n, starts in seen.items():
        h, g = window_hashes(words, cache, n)
        at = np.array(sorted(starts), "int64")
        out += [{"h": x, "g": y, "start": z, "k": n} for x, y, z in zip(h[at].view("int64").tolist(), g[at].view("int64").tolist(), at.tolist(), strict=True)]
    return out


def extended(text: Column, hits: Column) -> Column:
    """The windows of a text around its hits."""

    @F.pandas_udf(WINDOWS)
    def of(texts: pd.Series, all_hits: pd.Series) -> pd.Series:
        cache = Hashes()
        return pd.Series([windows_of(words_of(t), cache, [(h["place"], h["k"]) for h in hits]) for t, hits in zip(texts, all_hits, strict=True)])

    return of(text.cast("binary"), hits)


def all_windows(text: Column) -> Column:
    """All windows of a text, or the whole text if it is shorter."""

    @F.pandas_udf(WINDOWS)
    def of(texts: pd.Series) -> pd.Series:
        cache, out = Hashes(), []
        for t in texts:
            words = words_of(t)
            k = min(WINDOW, len(words))
            out.append(windows_of(words, cache, [(p, k) for p in range(len(words) - k + 1)] if k else []))
        return pd.Series(out)

    return of(text.cast("binary"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """Add n_words, n_hit, n_items, items (sorted as strings) and contaminated to the rows of ``docs``.

    A word is hit inside any occurrence of a window (``WINDOW`` consecutive words of an item, or a whole
    shorter item). A document is contaminated if some word is hit and 1 in ``share`` words or more.
    Null and empty texts have no words and are never hit; items without words match nothing; repeated
    items count once by id; all with a null id count as one in n_items and are left out of the list alone. Documents are told apart by id and hash of the text, so equal rows get
    equal results. Columns of these names are replaced, all others stay; empty tables are no error.
    """
    spark = docs.sparkSession
    text_batches(spark)
    results = ("n_words", "n_hit", "n_items", "items", "contaminated")
    docs = docs.drop(*results)
    # a null id as an empty array, so that joins and groups hold it
    named = F.when(F.col(item_col).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(item_col).cast("string")))
    items = settle(items.select(named.alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct())
    windows = settle(items.select("item", F.explode(all_windows(F.col("text"))).alias("w")).select("item", "w.h", "w.g", "w.k").distinct())
    known = settle(items.select(F.explode(prints(F.col("text"), list(range(1, WINDOW)), True)["hashes"]).alias("h")).distinct())
    short = sorted(r[0] for r in windows.where(F.col("k") < WINDOW).select("k").distinct().collect())  # 12 values at most
    sieve = None
    if known.limit(SIEVE + 1).count() <= SIEVE:
        sieve = spark.sparkContext.broadcast(np.sort(known.toPandas()["h"].to_numpy("int64").view("uint64")))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(id_col).isNull().alias("n"), F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit(1), text_col).alias("y"))
    scanned = settle(docs.select(key.alias("key"), prints(F.col(text_col), short, False, sieve).alias("p")).select("key", "p.*"))
    hit = scanned.where(F.size("hashes") > 0).select("key", F.explode(F.arrays_zip("hashes", "places", "lengths")).alias("x"))
    hit = hit.select("key", F.col("x.hashes").alias("h"), F.struct(F.col("x.places").alias("place"), F.col("x.lengths").alias("k")).alias("hit")).join(known, "h", "left_semi")
    hits = settle(hit.groupBy("key").agg(F.collect_set("hit").alias("hits")))  # at most one place of each a word of one document
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text")).join(hits, "key")
    tried = texts.select("key", F.explode(extended(F.col("text"), F.col("hits"))).alias("w")).select("key", "w.*")
    matched = settle(tried.join(windows.select("h", "g", "k").distinct(), ["h", "g", "k"], "left_semi").distinct())
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("k")).alias("past"))))
    # spans in order: each adds what it covers beyond those before it
    none = F.struct(F.lit(0).alias("past"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.struct(F.greatest(s["past"], x["past"]).alias("past"), (s["n"] + F.greatest(F.lit(0), x["past"] - F.greatest(s["past"], x["start"]))).alias("n"))
    covered = matched.groupBy("key").agg(spans.alias("s")).select("key", F.aggregate("s", none, add)["n"].alias("n_hit"))
    of_key = matched.select("key", "h", "g", "k").distinct().join(windows, ["h", "g", "k"]).select("key", "item").distinct()
    listed = of_key.groupBy("key").agg(F.collect_list("item").alias("found")).select("key", F.size("found").cast("long").alias("n_items"), F.array_sort(F.flatten("found")).alias("items"))
    own = fresh(docs.columns, "_key")
    found = scanned.select("key", "n_words").distinct().join(covered, "key", "left").join(listed, "key", "left")
    found = found.select(F.col("key").alias(own), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = docs.withColumn(own, key).join(found, own).drop(own)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op10_decontamination(spark, sf_dir):
    """All documents against all benchmark items."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), spans AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))
), hits AS (
  SELECT s.doc_id, w.item_id, s.i, s.k FROM spans s JOIN windows w ON s.k = w.k AND s.s = w.s
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""
