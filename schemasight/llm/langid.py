"""Language identification by unigrams of a fixed public vocabulary, summed over all segmentations.

A text's runs of letters, in lower case, are words; a word's probability in a language is the sum, over all
ways to cut it into pieces of the vocabulary, of the product of the pieces' probabilities. A forward pass
over the word's characters adds these up; a forward-backward pass over the training words of a
language gives the expected counts of which the probabilities are made.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settle, table, text_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The model is fitted on about so many documents of each language at most, chosen by a hash of id and text.
SAMPLE = 4_000
#: Languages in one model (vocabulary x languages), which is sent to all tasks; more of them make several models.
LANGUAGES = 64
LETTERS = re.compile(r"[^\W\d_]+")
#: Each character multiplies a word's probability by this, so that products of small numbers stay in range; it is taken out again at the end.
LIFT = 1e4
#: Words up to this length are taken side by side, longer ones one by one. Below 128, and batches of words below 8192: see how matches packs them.
LONG = 64
#: Numbers that a worker keeps of words already scored, in each of two generations: when the younger is full, it takes the place of the older,
#: and words found in the older come back to the younger. So frequent words stay, however many rare ones pass by.
KEPT = 1 << 19


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Piece to number, and -1 for what is only the beginning of pieces; 0 stands for any character that no piece covers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(k) for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    found = {p: k for k, p in enumerate(found, 1)}
    return {p[:n]: -1 for p in found for n in range(1, len(p))} | {"": 0} | found


def matches(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Rows (end, word, start, piece) of all pieces in all words."""
    out, get = [], known.get
    for w, word in enumerate(words):
        n = len(word)
        for start in range(n):
            here, alone = w << 23 | start << 16, True
            for end in range(start + 1, n + 1):
                piece = get(word[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    out.append(end << 36 | here | piece)
                    alone = alone and end > start + 1
            if alone:
                out.append(start + 1 << 36 | here)
    found = np.sort(np.array(out, "int64"))
    return np.stack([found >> 36, found >> 23 & 0x1FFF, found >> 16 & 0x7F, found & 0xFFFF], 1)


def forward(words: list[str], found: np.ndarray, lifted: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: array (place, word, language). lifted: piece probabilities times LIFT a character."""
    sums = np.zeros((max(map(len, words)) + 1, len(words), lifted.shape[1]))
    sums[0] = 1
    cuts = np.searchsorted(found[:, 0], np.arange(1, len(sums) + 1))
    for end in range(1, len(sums)):
        part = found[cuts[end - 1] : cuts[end]]
        if len(part):
            first = np.flatnonzero(np.diff(part[:, 1], prepend=-1))
            sums[end, part[first, 1]] = np.add.reduceat(sums[part[:, 2], part[:, 1]] * lifted[part[:, 3]], first)
    return sums


def backward(words: list[str], found: np.ndarray, lifted: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each suffix, like ``forward``."""
    sums = np.zeros((max(map(len, words)) + 1, len(words), lifted.shape[1]))
    sums[[len(w) for w in words], range(len(words))] = 1
    order = found[np.lexsort((found[:, 1], found[:, 2]))]
    cuts = np.searchsorted(order[:, 2], np.arange(len(sums) + 1))
    for start in reversed(range(len(sums) - 1)):
        part = order[cuts[start] : cuts[start + 1]]
        if len(part):
            first = np.flatnonzero(np.diff(part[:, 1], prepend=-1))
            sums[start, part[first, 1]] += np.add.reduceat(sums[part[:, 0], part[:, 1]] * lifted[part[:, 3]], first)
    return sums


def long_word(word: str, known: dict[str, int], lifted: np.ndarray) -> np.ndarray:
    """The log-probabilities of a word of any length: the forward pass with its window brought back to range at each character."""
    longest, scale = max(map(len, known)), np.zeros(lifted.shape[1])
    window = [np.ones(lifted.shape[1])]
    for end in range(1, len(word) + 1):
        total = np.zeros(lifted.shape[1])
        for back in range(1, min(longest, end) + 1):
            piece = known.get(word[end - back : end])
            piece = 0 if back == 1 and (piece is None or piece < 0) else piece
            if piece is not None and piece >= 0:
                total += window[-back] * lifted[piece]
        window = [x / total for x in [*window[1 - longest :], total]]
        scale += np.log(total)
    return scale - len(word) * math.log(LIFT)


def log_probabilities(words: list[str], known: dict[str, int], lifted: np.ndarray) -> np.ndarray:
    """Array (word, language)."""
    out = np.zeros((len(words), lifted.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for at in range(0, len(short), 4096):
        part = [words[k] for k in short[at : at + 4096]]
        sums = forward(part, matches(part, known), lifted)
        out[short[at : at + 4096]] = np.log(sums[[len(w) for w in part], range(len(part))]) - np.array([[len(w)] for w in part]) * math.log(LIFT)
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = long_word(w, known, lifted)
    return out


def long_counts(word: str, known: dict[str, int], own: np.ndarray) -> tuple[list[int], list[float]]:
    """The expected counts of the pieces of a word of any length in one language, by logarithms: (pieces, counts)."""
    longest, n = max(map(len, known)), len(word)
    logs = np.log(own).tolist()
    edges = []
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            piece = known.get(word[start:end])
            piece = 0 if end - start == 1 and (piece is None or piece < 0) else piece
            if piece is not None and piece >= 0:
                edges.append((start, end, piece))

    def add(x: float, y: float) -> float:
        big, small = max(x, y), min(x, y)
        return big if small == -math.inf else big + math.log1p(math.exp(small - big))

    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for start, end, piece in edges:
        ahead[end] = add(ahead[end], ahead[start] + logs[piece])
    for start, end, piece in sorted(edges, reverse=True):
        behind[start] = add(behind[start], logs[piece] + behind[end])
    return [p for _, _, p in edges], [math.exp(ahead[s] + logs[p] + behind[e] - ahead[n]) for s, e, p in edges]


def words_of(text: str) -> list[str]:
    return ["▁" + w for w in LETTERS.findall(text.lower())]


def lift(probabilities: np.ndarray, known: dict[str, int]) -> np.ndarray:
    width = np.ones(len(probabilities))
    for piece, k in known.items():
        if k > 0:
            width[k] = len(piece)
    return probabilities * (LIFT**width)[:, None]


class Model:
    """Languages, and each piece's probability in each: an array (piece, language)."""

    def __init__(self, languages: list[str], probabilities: np.ndarray, vocabulary: str):
        self.languages, self.probabilities, self.vocabulary = languages, probabilities, vocabulary
        self.mark = zlib.crc32(probabilities.tobytes())


#: What a worker keeps of the latest model between batches: words already scored.
_scored: dict = {"mark": None}


def looked_up(words: list[str], model: Model) -> tuple[dict[str, int], np.ndarray]:
    """(rows, table): where each of some different words stands in a table of log-probabilities (row, language)."""
    known, width = pieces(model.vocabulary), len(model.languages)
    if _scored["mark"] != model.mark:
        _scored.update(mark=model.mark, young=({}, np.zeros((0, width))), old=({}, np.zeros((0, width))), lifted=lift(model.probabilities, known))
    rows, table = _scored["young"]
    new = [w for w in words if w not in rows]
    if rows and (len(rows) + len(new)) * width > KEPT:
        _scored["old"] = rows, table
        rows, table, new = {}, table[:0], words
    if new:
        before, vectors = _scored["old"]
        again = [w for w in new if w in before]
        fresh_ = [w for w in new if w not in before]
        rows.update(zip(again + fresh_, range(len(rows), len(rows) + len(new)), strict=True))
        table = np.concatenate([table, vectors[[before[w] for w in again]], log_probabilities(fresh_, known, _scored["lifted"])])
    _scored["young"] = rows, table
    return rows, table


def score_texts(texts, model: Model) -> list[tuple[str | None, float, float]]:
    """(language, log of the text's probability in it, log of the sum over all languages of the model) of each text; no language for
    null and without a letter."""
    split = [words_of(t) if t else [] for t in texts]
    rows, table = looked_up(list({w for ws in split for w in ws}), model)
    out = []
    for text, ws in zip(texts, split, strict=True):
        if not ws or not any(map(str.isalpha, text)):
            out.append((None, 0.0, 0.0))
            continue
        logs = table[np.fromiter(map(rows.__getitem__, ws), "int64", len(ws))].sum(0)
        best = int(logs.argmax())
        out.append((model.languages[best], float(logs[best]), float(logs[best] + np.log(np.exp(logs - logs[best]).sum()))))
    return out


def expected(counts: pd.DataFrame, model: Model) -> np.ndarray:
    """Expected counts of the pieces in words (lang, word, n) under the model: an array (piece, language)."""
    known = pieces(model.vocabulary)
    lifted, out = lift(model.probabilities, known), np.zeros(model.probabilities.shape)
    for lang, all_ in counts.groupby("lang"):
        column = model.languages.index(lang)
        own, long = lifted[:, [column]], all_["word"].str.len() > LONG
        part = all_[~long]
        for at in range(0, len(part), 4096):
            words, n = part["word"].iloc[at : at + 4096].tolist(), part["n"].iloc[at : at + 4096].to_numpy("float64")
            found = matches(words, known)
            ahead, behind = forward(words, found, own)[:, :, 0], backward(words, found, own)[:, :, 0]
            end, word, start, piece = found.T
            share = ahead[start, word] * own[piece, 0] * behind[end, word] / behind[0, word]
            out[:, column] += np.bincount(piece, share * n[word], len(out))
        for word, n in zip(all_["word"][long], all_["n"][long], strict=True):
            piece, share = long_counts(word, known, model.probabilities[:, column])
            out[:, column] += n * np.bincount(piece, share, len(out))
    return out


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", vocabulary: str = VOCABULARY, rounds: int = 2, sample: int = SAMPLE) -> list[Model]:
    """Fit piece probabilities to the labelled texts of ``df`` by expectation maximisation: models of up to ``LANGUAGES`` languages.

    Rows with a null text or language teach nothing. About ``sample`` documents of each language are used, chosen
    by a hash of id and text (equal rows are chosen or not together). The words of these are counted once, long ones too; each round is a pass over the counts, of which the driver gets
    a sum for each piece and language of one model. Languages are fitted independently of each other.
    """
    text_batches(df.sparkSession)
    df = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    sizes = df.groupBy("lang").count().withColumn("rate", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # their names alone
    if not languages:
        return []

    def count(batches):
        for batch in batches:
            words = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words[lang].update(words_of(text))
            yield pd.DataFrame([(lang, w, n) for lang, c in words.items() for w, n in c.items()], columns=["lang", "word", "n"])

    chosen = df.join(F.broadcast(sizes.select("lang", "rate")), "lang").where(F.pmod("hash", F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("lang", "text")  # a row a language
    counts = settle(chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    return [fitted(counts, languages[at : at + LANGUAGES], vocabulary, rounds) for at in range(0, len(languages), LANGUAGES)]


def fitted(counts: DataFrame, languages: list[str], vocabulary: str, rounds: int) -> Model:
    """The model of some languages from the counts (lang, word, n) of their words."""
    size = max(pieces(vocabulary).values()) + 1
    model = Model(languages, np.full((size, len(languages)), 1 / size), vocabulary)
    counts = counts.where(F.col("lang").isin(languages))
    for _ in range(rounds):
        sent = counts.sparkSession.sparkContext.broadcast(model)

        def step(batches, sent=sent):
            total = np.zeros(sent.value.probabilities.shape)
            for batch in batches:
                total += expected(batch, sent.value)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = counts.mapInPandas(step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.full(model.probabilities.shape, 0.01)
        new[sums["piece"], sums["lang"]] += sums["n"]
        model = Model(languages, new / new.sum(0), vocabulary)
    return model


def identify(df: DataFrame, models: list[Model], text_col: str = "text") -> DataFrame:
    """Add lang_pred and score: the most probable language of each whole text, and its share (0 to 1) among all.

    A null text, one without a letter, or no model gives 'und' and 0. Of equally probable languages the first by name
    is taken; equal texts get equal results. Columns of these names are replaced; an empty table gives an empty one.
    """
    text_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    if not models:
        return df.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def of(model: Model):
        sent = df.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("struct<lang: string, log: double, total: double>")
        def scores(texts: pd.Series) -> pd.DataFrame:
            rows, part, held = [], [], 0
            for text in texts:  # a bounded number of words at a time
                part.append(text)
                held += len(text or "")
                if held > 1 << 20:
                    rows += score_texts(part, sent.value)
                    part, held = [], 0
            rows += score_texts(part, sent.value)
            return pd.DataFrame(rows, columns=["lang", "log", "total"])

        return scores(F.col(text_col))

    own = fresh(df.columns)
    found = df.withColumn(own, F.array(*[of(m) for m in models]))
    top = F.array_max(F.transform(own, lambda x: x["log"]))
    best = F.filter(own, lambda x: x["log"] == top)[0]["lang"]
    share = 1 / F.aggregate(own, F.lit(0.0), lambda sum_, x: sum_ + F.exp(x["total"] - top))
    return found.select(*names, F.coalesce(best, F.lit("und")).alias("lang_pred"), F.when(best.isNull(), 0.0).otherwise(share).alias("score"))


def fold(id_col: str = "doc_id", of: int = 3):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def model_of(spark: SparkSession, docs: DataFrame) -> list[Model]:
    """Learned from the documents that are not held out."""
    return train(docs.where(fold() != 1))


def op3_language_id(spark, sf_dir):
    """The language of all documents; a third of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text", (fold() == 1).alias("held_out")), model_of(spark, docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
