"""Token counts of the sections of documents: each text is encoded once as a whole, and its tokens are then
dealt to the sections whose characters they cover."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the usual byte-level vocabularies split a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most", "split")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The encoding, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, "int64")
    widths[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def token_ends(text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> np.ndarray:
    """Where each token of the text ends, in bytes; it starts where the one before ends."""
    coder, widths = encoding(path, pattern)
    return np.cumsum(widths[coder.encode_ordinary(text)])


def character_starts(data: bytes) -> np.ndarray:
    """The byte at which each character starts, and the length of all."""
    return np.append(np.flatnonzero(np.frombuffer(data, "u1") & 0xC0 != 0x80), len(data))


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary).

    ends: of the tokens; bounds: starts of the sections and the end of the last, in the same unit, so
    tokens and sections both tile the text. Their interval join is the list of stretches between all of these
    points: each lies in one token and one section.
    """
    sections = len(bounds) - 1
    if not len(ends) or not sections:
        return np.zeros(sections), 0
    cuts = np.unique(np.concatenate([[0], ends, bounds]))
    start, width = cuts[:-1], np.diff(cuts)
    token = np.searchsorted(ends, start, "right")
    section = np.searchsorted(bounds, start, "right") - 1
    change = np.flatnonzero(np.diff(token, prepend=-1))
    crossing = int((np.diff(np.append(change, len(token))) > 1).sum())
    if rule == "split":
        return np.bincount(section, width / np.diff(ends, prepend=0)[token], sections), crossing
    if rule == "first":
        chosen = section[change]
    elif rule == "last":
        chosen = section[np.append(change[1:], len(token)) - 1]
    else:  # the widest stretch, the earlier of equal ones
        order = np.lexsort((start, -width, token))
        chosen = section[order[np.flatnonzero(np.diff(token[order], prepend=-1))]]
    return np.bincount(chosen, minlength=sections).astype("float64"), crossing


def count_tokens(df: DataFrame, text_col: str, widths_col: str, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Add n_tokens, n_crossing and section_tokens (array of double, one number a section).

    ``widths_col``: the widths in characters of the sections or fields that the text is made of, from its
    start; what they leave over is one more section, and what goes beyond the text is empty. A token
    that lies in several sections counts by ``rule``: for the one with its ``first`` or ``last`` byte, for the
    one with ``most`` of its bytes (the earlier of equals), or for all, ``split`` by bytes; so the numbers
    always add up to n_tokens. A null text has no tokens and no sections, null and negative widths are 0 and a null list is empty; equal rows get equal counts.
    Very long texts are encoded whole, each in one task, with memory for their token ends and bytes; an empty table gives an empty one.
    The vocabulary's path must hold on all machines. Columns of these names are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    @F.pandas_udf("struct<n_tokens: long, n_crossing: long, section_tokens: array<double>>")
    def of(texts: pd.Series, all_widths: pd.Series) -> pd.DataFrame:
        rows = []
        for text, widths in zip(texts, all_widths, strict=True):
            if text is None:
                rows.append((0, 0, np.zeros(0)))
                continue
            data = text.encode()
            ends = token_ends(text, vocabulary, pattern)
            starts = character_starts(data)
            places = np.cumsum(np.maximum(0, np.nan_to_num(np.asarray([] if widths is None else widths, "float64"))).astype("int64"))
            bounds = np.concatenate([[0], starts[np.clip(places, 0, len(starts) - 1)]])
            if bounds[-1] < len(data) or len(bounds) == 1:
                bounds = np.append(bounds, len(data))
            counts, crossing = attribute(ends, bounds, rule)
            rows.append((len(ends), crossing, counts))
        return pd.DataFrame(rows, columns=["n_tokens", "n_crossing", "section_tokens"])

    text_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("n_tokens", "n_crossing", "section_tokens")]
    own = fresh(df.columns)
    return df.withColumn(own, of(F.col(text_col), F.col(widths_col))).select(*names, f"{own}.*")


def sentence_widths(text: Column) -> Column:
    """The widths of a text's sentences and lines, each with the blank or line end behind it."""
    return F.transform(F.split(text, r"(?<=[.!?] |\n)", -1), F.char_length)


def op4_token_counts(spark, sf_dir):
    """Tokens of all documents, dealt to their sentences by the first byte."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("widths", sentence_widths(F.col("text")))
    out = count_tokens(docs, "text", "widths")
    return out.select("doc_id", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), F.coalesce(F.array_max("section_tokens"), F.lit(0.0)).cast("long").alias("most_tokens"), F.transform("section_tokens", lambda x: x.cast("long")).alias("section_tokens"))
