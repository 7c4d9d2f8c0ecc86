"""From raw documents to training shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes all that the one before kept, is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemasight.llm.common import numbered, settle, shared_dir, table
from schemasight.llm.decontaminate import decontaminate
from schemasight.llm.langid import identify, model_of
from schemasight.llm.mixing import mix, mixing_key, word_count
from schemasight.llm.sharding import shard_in_order
from schemasight.llm.shingles import near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if no language has this share of its probability.
LEAST_SHARE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and undecided ones go.

    Equal rows stay or go together. Very long texts are read whole, a bounded number of words at a time. An empty table gives an
    empty one; columns beside those of documents are cut, here and in the following stages.
    """
    found = identify(docs, model_of(spark, docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id, rows without an id last.

    Groups are links of texts whose five-word shingles are similar to 0.8 or more: first those whose SimHash fingerprints pigeonring finds
    close, then, between the groups so found, those that differ in more bits (see ``shingles``); texts without words, null ones too, are copies of each other. Rows are told apart by their place, so different texts may share an id
    and of equal rows one stays; among equal ids the least hash of the row decides. The choice is made
    on ids and places alone, and texts are joined to it once.
    """
    rows = numbered(docs.select(COLUMNS)).withColumn("_row", F.struct(F.xxhash64("_row.file").alias("file"), F.col("_row.row").alias("row")))
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(*COLUMNS).alias("x"), "_row").alias("order"))
    roots = near_copies(rows.select(F.col("_row").alias("key"), "text"))
    kept = ids.join(roots.select(F.col("key").alias("_row"), "root"), "_row").groupBy("root").agg(F.min("order").alias("first"))
    return rows.join(settle(kept.select("first._row")), "_row", "left_semi").select(COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. Null and empty texts are clean, equal rows are judged alike, and an empty
    table, of documents or of items, takes nothing away."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their weights, a row for each copy taken, in the order of the curriculum: its files hold ranges of
    positions, each in order. A null source counts as one of its own, null texts have no words; an empty table gives an empty one."""
    sized = docs.select(COLUMNS).withColumn("size", word_count(F.col("text"))).withColumn("key", mixing_key(F.col("doc_id"), F.col("text")))
    return mix(sized).select(COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard (0 to 15, by its id) and slot; within a shard the order of the curriculum is kept. Equal rows and
    rows without an id get slots of their own; an empty table gives an empty one."""
    return shard_in_order(docs.select(COLUMNS), "doc_id", 16)


STAGES = [
    ("language_id", keep_languages),
    ("simhash_dedup", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents in turn."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
