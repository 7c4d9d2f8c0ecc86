"""Language-model scores by Katz back-off (Katz, 1987) over n-grams of words.

Counts up to ``RELIABLE`` are discounted by Good-Turing estimates, larger ones by ``HALF``, so every context leaves
something for words it was not seen with; its back-off weight hands that on to the next shorter context so
that all probabilities after it add up to one exactly. Words never seen share what the single words leave,
as one further word.

Counting and scoring ask the same question, how often an n-gram occurs in training, so the n-grams travel once:

1. Texts are encoded in chunks of about ``CHUNK`` tokens, a row each, in a settled table.
2. A chunk sends each n-gram that it holds once, with its own training count, to the bucket of the
   n-gram's hash. So no n-gram is heavier than the number of chunks, however frequent it is.
3. A bucket adds up the counts: the table of n-gram counts, partitioned by order and n-gram, in the form of answers to the
   chunks. One chunk of those that sent an n-gram is told that it owns it.
4. A chunk evaluates each token: the longest n-gram that was seen gives the probability, and each longer one that was not
   asks for the weight of its context. Of the n-grams that it owns it sends, summed by
   context, what they take from the context's mass and from that of the shorter one.
5. These sums make the table of back-off weights, a row for each context that is asked for; a join brings them
   to the tokens that ask.
"""

from __future__ import annotations

import struct
from array import array
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hand_back, settle, table, text_batches

ORDER = 2
RELIABLE, HALF = 5, 0.5
#: Tokens in a row of the encoded corpus, and n-grams aimed at in a bucket.
CHUNK, BUCKET = 1 << 19, 1 << 20
#: Buckets of single words, as a share of those of n-grams: there are so many fewer.
FEWER = 8
END, START = 2, 3
CODEC = pa.Codec("zstd", 1)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned longs as columns of bytes, without high bytes that are zero throughout, compressed."""
    n, widths, parts = len(columns[0]), [], []
    for c in columns:
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        widths.append(width)
        parts.append(np.ascontiguousarray(c.astype("<u8").view("u1").reshape(n, 8)[:, :width].T).tobytes())
    return struct.pack(f"<q{len(columns)}B", n, *widths) + CODEC.compress(b"".join(parts), asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    n, *widths = struct.unpack_from(f"<q{columns}B", data)
    size = n * sum(widths)
    flat = np.frombuffer(CODEC.decompress(data[8 + columns :], size, asbytes=True), "u1") if size else np.zeros(0, "u1")
    out, at = [], 0
    for width in widths:
        column = np.zeros((n, 8), "u1")
        column[:, :width] = flat[at : at + n * width].reshape(width, n).T
        out.append(column.view("<u8").ravel())
        at += n * width
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences; a running sum undoes it."""
    return np.diff(keys, prepend=np.uint64(0))


def good_turing(times: dict[int, int]) -> list[float]:
    """What a count of 1 to RELIABLE is worth, from the numbers of n-grams with counts 1 to RELIABLE + 1; where they are
    too few for the estimate, a count less HALF."""
    n = [0] + [times.get(r, 0) for r in range(1, RELIABLE + 2)]
    out = []
    for r in range(1, RELIABLE + 1):
        worth = r - HALF
        if n[1] and n[r] and (cut := (RELIABLE + 1) * n[RELIABLE + 1] / n[1]) < 1:
            share = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
            worth = r * share if 0 < share < 1 else worth
        out.append(worth)
    return out


class Chunk:
    """Texts being encoded: words are numbered as they come, the end of a text is number 0."""

    def __init__(self):
        self.numbers = defaultdict(None, {None: 0})
        self.numbers.default_factory = self.numbers.__len__
        self.tokens, self.ends, self.ids, self.train = array("i"), [], [], []

    def add(self, text: bytes | None) -> None:
        self.tokens.extend(map(self.numbers.__getitem__, (text or b"").lower().split()))
        self.tokens.append(0)
        self.ends.append(len(self.tokens))

    def row(self, number: int) -> dict:
        """The chunk as a table row; its words stand in order of frequency, so that most tokens are small numbers."""
        tokens = np.frombuffer(self.tokens, "i4")
        order = np.argsort(-np.bincount(tokens, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), "uint64")
        rank[order] = np.arange(len(order), dtype="uint64")
        words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w, 5) for w in self.numbers), "uint64", len(order))
        ids, train = pa.concat_arrays(self.ids), pa.concat_arrays(self.train)
        return {
            "chunk": TaskContext.get().partitionId() << 32 | number,
            "ids": pa.ListArray.from_arrays([0, len(ids)], ids),
            "train": pa.ListArray.from_arrays([0, len(train)], train),
            "n_tokens": len(tokens),
            "ends": packed(gaps(np.array(self.ends, "uint64"))),
            "words": words[order].tobytes(),
            "tokens": packed(rank[tokens]),
        }


def encoded(batches, size: int):
    """Rows of texts (id, train, text) as rows of chunks of about ``size`` tokens."""
    chunk, made = Chunk(), 0

    def done():
        row = chunk.row(made)
        arrays = {name: x if isinstance(x, pa.Array) else pa.array([x]) for name, x in row.items()}
        return pa.RecordBatch.from_pydict(arrays)

    for batch in batches:
        texts, first = batch.column("text"), 0
        for k in range(batch.num_rows):
            chunk.add(texts[k].as_py())
            full = len(chunk.tokens) >= size
            if full or k == batch.num_rows - 1:
                chunk.ids.append(batch.column("id").slice(first, k + 1 - first))
                chunk.train.append(batch.column("train").slice(first, k + 1 - first))
                first = k + 1
            if full:
                yield done()
                chunk, made = Chunk(), made + 1
                hand_back()
    if chunk.ends:
        yield done()


class Tokens(NamedTuple):
    """A chunk opened: where its texts begin and end, which tokens teach, and of each order the
    n-grams' sorted hashes (keys) and which of them ends at each token (at)."""

    ends: np.ndarray
    first: np.ndarray
    teaches: np.ndarray
    keys: list[np.ndarray]
    at: list[np.ndarray]


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def opened(row, order: int) -> Tokens:
    ends = np.cumsum(unpacked(row["ends"], 1)[0]).astype("int64")
    tokens, words = unpacked(row["tokens"], 1)[0].astype("int64"), np.frombuffer(row["words"], "uint64")
    sizes = np.diff(ends, prepend=0)
    first, keys, at = ends - sizes, [], []
    word = gram = words[tokens]
    for n in range(1, order + 1):
        if n > 1:
            context = np.empty_like(gram)
            context[1:] = gram[:-1]
            context[first] = START + n - 1  # as many starts as the context is long
            gram = mixed(context, word)
        found, which = np.unique(gram, return_inverse=True)
        keys.append(found)
        at.append(which.astype("int32"))
    return Tokens(ends, first, np.repeat(np.asarray(row["train"], bool), sizes), keys, at)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted keys stand in order of buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("int64")


def cut(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of the ranges of sorted keys that go to each bucket."""
    of = bucket_of(keys, buckets)
    at = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
    return [(int(of[i]), i, j) for i, j in zip(at, at[1:], strict=False)]


def requests(chunks, order: int, buckets: int):
    """The n-grams of each chunk, with their training counts in it, dealt to their buckets."""
    for batch in chunks:
        for _, row in batch.iterrows():
            t, rows = opened(row, order), []
            for n, (keys, at) in enumerate(zip(t.keys, t.at, strict=True), 1):
                times = np.bincount(at[t.teaches], minlength=len(keys)).astype("uint64")
                for b, i, j in cut(keys, few(buckets, n)):
                    rows.append((n, b, row["chunk"], packed(gaps(keys[i:j]), times[i:j])))
            yield pd.DataFrame(rows, columns=["order", "bucket", "chunk", "data"])
            del t, rows
            hand_back()


def few(buckets: int, order: int) -> int:
    return buckets if order > 1 else buckets // FEWER + 1


def count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The total counts of one bucket's n-grams, as an answer to each chunk: twice the count, and 1 more for the owner.
    stat, in the first row: tokens, types, and the types with counts 1 to RELIABLE + 1."""
    keys, times = zip(*(unpacked(d, 2) for d in rows["data"]), strict=True)
    sizes = np.cumsum([len(k) for k in keys])
    keys, times = np.concatenate([np.cumsum(k, dtype="uint64") for k in keys]), np.concatenate(times).astype("int64")
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    sums = np.add.reduceat(times[order], np.flatnonzero(new))
    answer = np.empty(len(keys), "uint64")
    answer[order] = 2 * sums[np.cumsum(new) - 1] + new
    stat = [int(sums.sum()), int((sums > 0).sum()), *np.bincount(sums[sums <= RELIABLE + 1], minlength=RELIABLE + 2)[1:].tolist()]
    return pd.DataFrame({"order": rows["order"], "bucket": rows["bucket"], "chunk": rows["chunk"], "data": [packed(x) for x in np.split(answer, sizes[:-1])], "stat": [stat, *[[]] * (len(rows) - 1)]})


class Constants(NamedTuple):
    """What describes the whole training corpus: texts, tokens, types, the share of unseen words, and of each order what small counts are worth."""

    texts: int
    tokens: int
    types: int
    unseen: float
    worth: list[list[float]]


def constants_of(counted: DataFrame, texts: int, order: int) -> Constants:
    """From the sums of all buckets, a row for each order."""
    places = range(RELIABLE + 3)
    found = counted.where(F.size("stat") > 0).groupBy("order").agg(*[F.sum(F.get("stat", F.lit(k))).alias(f"s{k}") for k in places]).collect()
    stat = {r["order"]: [r[f"s{k}"] for k in places] for r in found}
    tokens, types, *times = stat.get(1, [0] * (RELIABLE + 3))
    worth = [good_turing(dict(enumerate(stat.get(n, [0] * (RELIABLE + 3))[2:], 1))) for n in range(1, order + 1)]
    small = sum(n * (r - w) for r, (n, w) in enumerate(zip(times, worth[0], strict=False), 1))
    unseen = (small + HALF * (types - sum(times[:RELIABLE]))) / tokens if tokens else 1.0
    return Constants(texts, tokens, types, unseen, worth)


def worth_of(counts: np.ndarray, small: list[float]) -> np.ndarray:
    """What counts are worth after the discount; 0 for 0."""
    known = np.array([0.0, *small])
    return np.where(counts > RELIABLE, counts - HALF, known[np.minimum(counts, RELIABLE)])


EVALUATED = "kind string, order int, bucket int, chunk long, data binary, keys array<long>, pos array<int>, times array<int>, n_tokens array<long>, n_known array<long>, base array<double>, part array<double>"


def evaluate(row, answers: pd.DataFrame, k: Constants, order: int, buckets: int) -> pd.DataFrame:
    """A chunk's rows of kind doc (what is known of each text's score), ask (contexts whose weights its tokens need)
    and mass (what the n-grams that it owns take from each context)."""
    t = opened(row, order)
    n_docs, size = len(t.ends), int(t.ends[-1])
    of_doc = np.repeat(np.arange(n_docs), np.diff(t.ends, prepend=0))
    out, before, last = [], None, None
    for n in range(1, order + 1):
        mine = answers[answers["order"] == n].sort_values("bucket")
        answer = np.concatenate([unpacked(d, 1)[0] for d in mine["data"]]).astype("int64")
        total, owned = answer >> 1, (answer & 1 == 1) & (answer > 1)
        at, counts = t.at[n - 1], total[t.at[n - 1]]
        if n == 1:
            probability = np.where(counts > 0, worth_of(counts, k.worth[0]) / max(1, k.tokens), k.unseen)
            base = np.bincount(of_doc, np.log10(counts + 1) - np.log10(k.tokens + k.types + 1), n_docs)
            known = np.bincount(of_doc[counts > 0], minlength=n_docs)
            before = counts
            continue
        # the context: the n-gram, one shorter, that ends at the token before
        context_count, context = np.empty(size, "int64"), np.empty(size, "uint64")
        context_count[1:], context[1:] = before[:-1], t.keys[n - 2][t.at[n - 2][:-1]]
        context_count[t.first], context[t.first] = k.texts, START + n - 1
        seen = counts > 0
        ask = ~seen & (context_count > 0)
        # of each n-gram owned, one token that it ends at
        token = np.empty(len(total), "int64")
        token[at] = np.arange(size)
        token = token[owned]
        worth = worth_of(total[owned], k.worth[n - 1])
        names, of = np.unique(np.concatenate([context[token], context[ask]]), return_inverse=True)
        mine, n_own = of[: len(token)], len(token)
        held = np.zeros(len(names), "uint64")
        held[mine] = context_count[token]
        asked = np.zeros(len(names), "uint64")
        asked[of[n_own:]] = 1
        sums = [np.bincount(mine, x, len(names)).view("uint64") for x in (worth, probability[token])]
        for b, i, j in cut(names, buckets):
            out.append({"kind": "mass", "order": n, "bucket": b, "data": packed(gaps(names[i:j]), held[i:j], asked[i:j], *(s[i:j] for s in sums))})
        # the same context asked for again by the same text
        pair, times = np.unique(of[n_own:] * n_docs + of_doc[ask], return_counts=True)
        if len(pair):
            out.append({"kind": "ask", "order": n, "bucket": 0, "data": b"", "keys": names[pair // n_docs].view("int64"), "pos": (pair % n_docs).astype("int32"), "times": times.astype("int32")})
        probability = np.where(seen, worth_of(counts, k.worth[n - 1]) / np.maximum(1, context_count), probability)
        before = counts
    docs = {"n_tokens": np.diff(t.ends, prepend=0), "n_known": known, "base": base, "part": np.bincount(of_doc, np.log10(probability), n_docs)}
    out.append({"kind": "doc", "order": 0, "bucket": 0, "data": b"", **docs})
    found = pd.DataFrame(out, columns=[c.split()[0] for c in EVALUATED.split(", ")])
    found["chunk"] = row["chunk"]
    for c in found.columns[5:]:
        found[c] = [x if isinstance(x, np.ndarray) else None for x in found[c]]
    return found


def weigh(rows: pd.DataFrame) -> pd.DataFrame:
    """log10 of the back-off weights of one bucket's contexts that some chunk asks for."""
    columns = [np.concatenate(x) for x in zip(*((np.cumsum(key, dtype="uint64"), *rest) for key, *rest in (unpacked(d, 5) for d in rows["data"])), strict=True)]
    names, of = np.unique(columns[0], return_inverse=True)
    held, asked = (np.zeros(len(names), "int64") for _ in range(2))
    np.maximum.at(held, of, columns[1].astype("int64"))
    np.maximum.at(asked, of, columns[2].astype("int64"))
    worth, shorter = (np.bincount(of, c.view("float64"), len(names)) for c in columns[3:])
    keep = (asked > 0) & (held > 0)
    weight = np.log10((1 - worth[keep] / held[keep]) / (1 - shorter[keep]))
    return pd.DataFrame({"order": rows["order"].iat[0], "key": names[keep].view("int64"), "weight": weight})


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``df``.

    Learns n-grams up to ``order`` words from the rows where ``train`` holds (null counts as not). Scores are log10 probabilities of
    the whole text; base_score adds one to the counts of single words. A null text counts as empty: the end
    alone. Every row is scored for itself, so equal rows teach once each and get equal scores, and ids may be null or repeat. With nothing to
    learn from, every token has the probability of an unseen word. Other columns do not matter; an empty table gives an empty one. A very
    long text is one chunk however long it is, so a task's memory grows with its tokens.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = settle(rows.mapInArrow(lambda b: encoded(b, chunk), f"chunk long, ids array<{kind}>, train array<boolean>, n_tokens long, ends binary, words binary, tokens binary"))
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0)).alias("texts")).first()
    buckets = size["n"] // bucket + 1
    body = chunks.select("chunk", "train", "ends", "words", "tokens")
    sent = body.mapInPandas(lambda b: requests(b, order, buckets), "order int, bucket int, chunk long, data binary")

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        out = count_bucket(rows)
        hand_back()
        return out

    counted = settle(sent.groupBy("order", "bucket").applyInPandas(totals, "order int, bucket int, chunk long, data binary, stat array<long>"))
    k = constants_of(counted, size["texts"], order)

    def answered(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = evaluate(rows.iloc[0], answers, k, order, buckets)
        hand_back()
        return out

    found = settle(body.groupBy("chunk").cogroup(counted.select("order", "bucket", "chunk", "data").groupBy("chunk")).applyInPandas(answered, EVALUATED))
    docs = found.where("kind = 'doc'").select("chunk", F.arrays_zip("n_tokens", "n_known", "base", "part").alias("d"))
    docs = docs.join(chunks.select("chunk", F.arrays_zip("ids", "train").alias("i")), "chunk").select("chunk", F.posexplode(F.arrays_zip("i", "d")).alias("pos", "x"))
    docs = settle(docs.select("chunk", "pos", "x.i.ids", "x.i.train", "x.d.*"))
    discard(chunks)
    discard(counted)

    weights = found.where("kind = 'mass'").select("order", "bucket", "data").groupBy("order", "bucket").applyInPandas(weigh, "order int, key long, weight double")
    asks = found.where("kind = 'ask'").select("order", "chunk", F.explode(F.arrays_zip("keys", "pos", "times")).alias("x")).select("order", F.col("x.keys").alias("key"), "chunk", "x.pos", "x.times")
    backed = asks.join(weights, ["order", "key"]).groupBy("chunk", "pos").agg(F.sum(F.col("times") * F.col("weight")).alias("weight"))
    out = docs.join(backed, ["chunk", "pos"], "left")
    return out.select(
        F.col("ids").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(k.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("part") + F.coalesce("weight", F.lit(0.0))).alias("score"),
    )


def op5_katz(spark, sf_dir):
    """Scores of all documents by a model of those whose id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    return score_texts(docs, fold != 2)
