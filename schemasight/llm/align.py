"""Two tokenizers aligned: every distinct text is encoded by both once, the pairs of tokens that overlap are counted over the corpus, and
each document is measured against these counts."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hand_back, salted_lookup, settle, table, text_batches

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A pair of ids is one number: A's id times this, plus B's.
WIDTH = 1 << 20
#: So many pairs at most are broadcast with their counts; the others are joined.
FREQUENT = 1 << 18
#: Characters that are encoded and aligned at a time, at least: memory goes with it.
STRETCH = 1 << 17
#: Units of text (words, mostly) that a worker remembers aligned, and the most characters of one; others are aligned whenever they come.
REMEMBERED, SHORT = 1 << 17, 64


@lru_cache(maxsize=2)
def byte_level(path: str):
    """The byte-level tokenizer and the bytes of each of its tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    # The usual alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for what follows U+00FF (fixed values).
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = coder.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return coder, out


@lru_cache(maxsize=2)
def pieces(path: str):
    """The tokenizer by pieces and the bytes of each of its tokens."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for k in range(coder.get_piece_size()):
        piece = coder.id_to_piece(k)
        out.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(k) else piece.replace("▁", " ").encode())
    return coder, out


def stretches(text: str) -> Iterator[str]:
    """A text in stretches that start at a blank or line end behind other characters, where no token goes across."""
    start = 0
    while start < len(text):
        cut = _EDGE.search(text, start + STRETCH)
        end = cut.start() + 1 if cut else len(text)
        yield text[start:end]
        start = end


def byte_level_ids(coder, text: str) -> list[int]:
    return [k for part in stretches(text) for k in coder.encode_batch_fast([part], add_special_tokens=False)[0].ids]


#: A blank or line end behind what is no white space by any definition.
_EDGE = re.compile(r"\S(?=[ \n])")
#: What lies between such edges.
_UNITS = re.compile(r"\s*+\S++(?:[^\S \n]\s*+(?:\S++|\Z))*+|\s+")


class Aligner:
    """Encodes texts by both tokenizers and aligns their tokens by bytes.

    No token of either side goes across the edges of a text, nor do the tokens between two edges depend on others, so what lies between edges is
    aligned by itself, once as long as it is remembered. Where B's vocabulary can't promise this, texts are aligned as one.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, a_bytes = byte_level(a_path)
        self.b, b_bytes = pieces(b_path)
        self.bytes = a_bytes, b_bytes
        self.widths = tuple(np.array([len(x) for x in side], "int64") for side in self.bytes)
        most = max(map(len, self.bytes))
        #: Each id as text with what may follow it: nothing, a comma, a bar, a semicolon.
        self.shown = [f"{k}{end}" for k in range(most) for end in ("", ",", "|", ";")]
        self.long = np.array(list(map(len, self.shown)), "int64")
        #: Units remembered, and those of the time before; the latter make room when there are ``REMEMBERED`` new ones.
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        probe = self.b.encode("\n \n  x")
        self.local = b"".join(map(b_bytes.__getitem__, probe)) == b" \n \n  x" and not any(b"\n" in x and x != b"\n" or b" " in x.lstrip(b" ") for x in b_bytes)

    def aligned(self, units: list[str]) -> list[tuple] | None:
        """(numbers of A's tokens, B's tokens and groups, pairs of ids of each link as bytes, groups as text) of each unit; units follow each other
        as in a text. None where either side doesn't give their bytes."""
        whole = "".join(units)
        # B puts a blank before what it gets: a line end keeps it apart from the text, or it is the text's own.
        ids = byte_level_ids(self.a, whole), self.b.encode("\n" + whole)[2:] if self.local else self.b.encode(whole[1:])
        data = whole.encode()
        if any(b"".join(map(side.__getitem__, own)) != data for side, own in zip(self.bytes, ids, strict=True)):
            return None
        a, b = (np.asarray(own, "int64") for own in ids)
        a_ends, b_ends = (np.cumsum(w[own]) for w, own in zip(self.widths, (a, b), strict=True))
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        again = ends[1:] == ends[:-1]
        common, cuts = ends[1:][again], ends[np.append(~again, True)]
        # Each stretch between two cuts lies in one token of each side, and each pair that overlaps shares one stretch.
        links = a[np.searchsorted(a_ends, cuts)] * WIDTH + b[np.searchsorted(b_ends, cuts)]
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_until, b_until = (np.cumsum(np.bincount(g, minlength=len(common))) for g in (a_group, b_group))
        order = np.empty(len(a) + len(b), "int64")
        order[np.arange(len(a)) + np.concatenate([[0], b_until])[a_group]] = a * 4 + 1 + (np.diff(a_group, append=-1) != 0)
        order[np.arange(len(b)) + a_until[b_group]] = b * 4 + 1 + 2 * (np.diff(b_group, append=-1) != 0)
        shown = "".join(map(self.shown.__getitem__, order.tolist()))
        until = np.cumsum(list(map(len, map(str.encode, units))))
        n_a, n_b, n_groups, n_links = (np.searchsorted(x, until, "right") for x in (a_ends, b_ends, common, cuts))
        texts = np.cumsum(self.long[order])[n_a + n_b - 1].tolist()
        data, n_links = links.tobytes(), (8 * n_links).tolist()
        numbers = (np.diff(x, prepend=0).tolist() for x in (n_a, n_b, n_groups))
        parts = [data[i:k] for i, k in zip([0, *n_links], n_links, strict=False)]
        return list(zip(*numbers, parts, [shown[i : k - 1] for i, k in zip([0, *texts], texts, strict=False)], strict=True))

    def recalled(self, units: list[str]) -> list[tuple] | None:
        """What ``aligned`` gives for the units of a text, with only those aligned that are not remembered."""
        found = list(map(self.known.get, units))
        if all(found):
            return found
        own = {u: self.older.get(u) for u in dict.fromkeys(u for u, x in zip(units, found, strict=True) if x is None)}
        new = [u for u, x in own.items() if x is None]
        got = self.aligned(new) if new else []
        if got is None:
            return None
        own.update(zip(new, got, strict=True))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update(x for x in own.items() if len(x[0]) <= SHORT)
        return [x or own[u] for u, x in zip(units, found, strict=True)]

    def align(self, text: str):
        """(numbers of A's tokens, B's tokens, groups and links, digest of the groups, pairs of ids that are linked, links of each); no tokens where
        either side doesn't give the bytes of the text."""
        counts, links, digest = [], [], hashlib.sha256()
        for part in stretches(" " + text) if self.local else [" " + text]:
            found = self.recalled(_UNITS.findall(part) if self.local else [part]) if text else None
            if found is None:
                return 0, 0, 0, 0, "", np.zeros(0, "int64"), np.zeros(0, "int64")
            n_a, n_b, n_groups, parts, shown = zip(*found, strict=True)
            digest.update((";" * bool(links) + ";".join(shown)).encode())
            counts.append((sum(n_a), sum(n_b), sum(n_groups)))
            links.append(b"".join(parts))
        links = np.frombuffer(b"".join(links), "int64")
        return *map(sum, zip(*counts, strict=True)), len(links), digest.hexdigest(), *np.unique(links, return_counts=True)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker, so that what it remembers serves all its tasks."""
    return Aligner(a_path, b_path)


ALIGNED = "h long, g long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def _aligned(a_path: str, b_path: str):
    def of(batches):
        both = aligner(a_path, b_path)
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in ALIGNED.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for given in batches:
            rows, held = [], 0
            for h, g, copies, text in zip(*(given.column(c) for c in ("h", "g", "copies", "text")), strict=True):
                *numbers, pairs, links = both.align(text.as_py())
                rows.append((h.as_py(), g.as_py(), copies.as_py(), *numbers, pairs, links))
                held += len(pairs)
                if held > 1 << 19:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        hand_back()

    return of


def align_texts(df: DataFrame, text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of the whole column: texts has a row for each distinct text that is neither null nor empty, with two hashes h and g, its copies, the
    numbers of tokens, groups and links, the digest of its groups, and its pairs of ids (A's times ``WIDTH`` plus B's) with the links of
    each; pairs has a row for each pair of ids with the number of rows of ``df`` (count) that hold it linked.

    Texts are dealt out whole, equal ones meet (after partial sums, so copies are no heavier than others) and are encoded once.
    Both paths must hold on all machines. Texts that either tokenizer doesn't give back byte for byte have no tokens.
    """
    text_batches(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(*_key("text"), "copies", "text").mapInArrow(_aligned(a_path, b_path), ALIGNED)
    texts = settle(texts)
    pairs = texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
    return texts, settle(pairs)


def _key(text: str):
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")


def measure(texts: DataFrame, pairs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """h, g, n_best and count_sum of each text: its links whose pair is the most frequent of its A id (ties included), and the sum of the counts
    of its links.

    The best counts (a row for each id of A's vocabulary at most) and up to ``frequent`` pairs with the largest counts are
    broadcast; links of the other pairs, which are rare, are joined to theirs by shuffle.
    """
    best = pairs.groupBy(F.floor(F.col("pair") / WIDTH).alias("a")).agg(F.max("count").alias("best"))
    judged = settle(pairs.withColumn("a", F.floor(F.col("pair") / WIDTH)).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best")))
    # Counts by powers of two: the least power above which no more than ``frequent`` pairs lie.
    sizes = {r.power: r.n for r in judged.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count("*").alias("n")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least - 1 in range(max(sizes, default=0) + 1) and held + sizes.get(least - 1, 0) <= frequent:
        least, held = least - 1, held + sizes.get(least - 1, 0)
    often = F.floor(F.log2("count")) >= least
    links = texts.select("h", "g", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("h", "g", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    known = F.broadcast(judged.where(often))
    found = links.join(known, "pair")
    if least:
        rare = links.join(F.broadcast(known.select("pair")), "pair", "left_anti")
        found = found.unionByName(rare.join(judged.where(~often), "pair"))
    sums = found.groupBy("h", "g").agg(F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    return sums


def align_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``df``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    See ``align_texts`` and ``measure``. Null and empty texts, and those that a tokenizer doesn't give back, have zeros and an empty digest. Ids may be null or
    repeated, equal rows have equal measures; an empty table gives an empty one; other columns are left out. Very long texts
    are read whole: A's tokens by stretches that start at white space, B's at once.
    """
    texts, pairs = align_texts(df, text_col, a_path, b_path)
    measures = texts.select("h", "g", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(measure(texts, pairs, frequent), ["h", "g"], "left")
    measures = settle(measures.withColumn("own", F.concat_ws(",", "h", "g")).drop("h", "g"))
    discard(texts)
    rows = settle(df.select(F.col(id_col), F.when(F.col(text_col) != "", F.concat_ws(",", *_key(text_col))).alias("own")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return salted_lookup(rows, measures, "own").select(id_col, *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_alignment(spark, sf_dir):
    """All documents, encoded by both vocabularies and aligned."""
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
