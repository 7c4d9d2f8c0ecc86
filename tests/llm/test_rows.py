"""The near-dedup stage tells rows apart by more than their ids."""

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, sf, rows):
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(5)
    return sorted(((r.doc_id, r.text) for r in C.keep_one_of_each(spark, df, sf).collect()), key=str)


def test_different_texts_of_one_id(spark, sf):
    x, y = "one two three four five six seven", "red green blue black white grey pink"
    assert kept(spark, sf, [(1, x), (1, y), (2, x), (3, y), (3, y)]) == [(1, x), (1, y)]


def test_rows_without_id(spark, sf):
    x, y = "one two three four five six seven", "red green blue black white grey pink"
    assert kept(spark, sf, [(None, x), (5, x), (None, y), (None, y)]) == [(5, x), (None, y)]
