"""Spelling variants: words one edit apart, found by asymmetric chunks, and the more frequent form that each leads to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_az, salted_lookup, settle, table

#: Groups of more words than this are filed again under longer chunks.
HOT = 512


def _filed(rows: DataFrame) -> DataFrame:
    """Add the key of each row (word, length, lo, hi, shift): what stands outside the open places lo to hi of a word of ``length``
    code points. A word that is one longer (shift 1) has its gram behind the open places one place later."""
    outside = F.xxhash64("length", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("hi") + F.col("shift") + 1, F.char_length("word")))
    return rows.withColumn("key", outside)


def _halves(rows: DataFrame) -> DataFrame:
    """Each open stretch in two: what was open in one half is a chunk of the other."""
    middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    both = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    parts = F.when(F.col("hi") - F.col("lo") > 1, both).otherwise(F.array(F.struct("lo", "hi")))
    return _filed(rows.withColumn("open", F.explode(parts)).select("word", "n", "length", "shift", "open.lo", "open.hi"))


def _matched(rows: DataFrame) -> DataFrame:
    """The pairs within the groups of a key: the word with chunks (a, the shorter or smaller one) and that with grams (b).

    A pair counts only where its first difference is open, so it comes once.
    """
    a = rows.where("shift = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "length", "hi")
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "shift")
    here = (F.col("hi") == F.col("length")) | (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi")))
    near = ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & here & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(near).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs (a, a_n, b, b_n) of distinct words (word, n) that differ by exactly one inserted, deleted or replaced code point, each once.

    The one word is cut into two chunks, its halves; one edit leaves one of them whole, and the other word has it as a gram
    at the same place or, if it is one longer, at most one place on. The lengths say at which, so only those of its positional
    grams are filed. Groups of more than ``hot`` rows are not compared: their open halves are halved again, until
    groups are small or one place is open; then nearly all of a group are near each other, or as few as the square of the alphabet.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size")).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    sized = sized.withColumn("length", F.col("size") - F.col("shift")).where("length >= 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("length"))
    rows = settle(_halves(sized.select("word", "n", "length", "shift", "lo", "hi")))
    found = []
    while True:
        crowded = rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > hot).select("key")
        crowded = settle(crowded)
        if crowded.isEmpty():
            found.append(settle(_matched(rows)))
            discard(rows)
            break
        found.append(settle(_matched(rows.join(crowded, "key", "left_anti"))))
        again = settle(_halves(rows.join(crowded, "key", "left_semi")))
        discard(rows)
        rows = again
    return reduce(DataFrame.unionByName, found)


def group_variants(df: DataFrame, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """One row per word of ``df`` (word string, n long): word, n, n_near, form, form_n and root.

    n_near is the number of near words (see ``near_words``); form is the one of largest n, the smallest in code-point order among equals, if its n is
    at least ``ratio`` times (2 or more) and more than the word's, else null; form_n is its n. root follows forms to the last. Rows of the same
    word are added up and a null n counts 0; a null word is no word and gives no row. Empty and very long words are words like others, and an
    empty table gives an empty one. Other columns are left out.
    """
    words = settle(df.where("word is not null").groupBy("word").agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).cast("long").alias("n")))
    pairs = near_words(words, hot)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    first = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("first")
    near = pairs.select(F.explode(ends).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), first)
    leads = (-F.col("first.m") >= ratio * F.col("n")) & (-F.col("first.m") > F.col("n"))
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("first.form")).alias("form"), F.when(leads, -F.col("first.m")).cast("long").alias("form_n")
    )
    out = settle(out)
    roots = settle(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps that have been followed
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(salted_lookup(roots, further, "root").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(roots)
        roots = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def runs_of_letters(df: DataFrame, id_col: str, text_col: str, damage: int, shortest: int, least: int) -> DataFrame:
    """word, n: the runs of Latin letters of whole texts, A-Z lower-cased, of at least ``shortest`` code points and ``least`` occurrences.

    A run loses one code point where ``damage`` divides the crc32 of "<id>:<run>" (a null id is empty): known misspellings, spread evenly.
    Null and empty texts have no runs. Words are counted in part before they are dealt out, so frequent ones are no heavier.
    """
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower_az(F.col(text_col)), "[^A-Za-zÀ-ÿ]+", -1)).alias("run"))
    runs = runs.where(F.char_length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def op11_spelling(spark, sf_dir):
    """The words of all documents, their near words, forms and roots."""
    words = runs_of_letters(table(spark, sf_dir, "documents"), "doc_id", "text", damage=97, shortest=5, least=3)
    return group_variants(words)


OP11_SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT b AS byte, CAST(b AS UBIGINT) AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM polynomial WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM polynomial WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents
), seen AS (
  SELECT run, id, count(*) AS k FROM runs GROUP BY run, id
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST(('0x' || h) AS UBIGINT)),
    lambda a, b: xor(a >> 8, crc.t[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM seen, crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS other, max(o.n) AS other_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.root WHERE form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.root FROM formed f JOIN walk ON walk.word = f.word JOIN formed z ON z.word = walk.root WHERE z.form IS NULL
"""
