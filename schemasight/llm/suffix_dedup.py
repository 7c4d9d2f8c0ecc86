"""Removal of repeated byte strings by suffix sorting.

A string of ``width`` bytes that starts at two places of the corpus is removed at both. All places are
covered in three steps. (1) Every window of ``width`` bytes has an anchor: the k-gram in it with the
least hash. Windows in a row that share an anchor are one run, and equal windows have equal anchors at
equal offsets, so only runs with a repeated anchor can matter. (2) Runs whose bytes are equal
throughout are repeated as a whole; one of each kind stands for all. The different runs of an anchor
form a group. A group too large for a task is split by content, however often it takes: windows are told apart by where
the anchor stands in them, in two halves, and each half is filed under the bytes that windows with the anchor there all hold, which are the
more the narrower the half is; halves alone with their bytes are not repeated, equal halves are, and what is left forms smaller groups. (3) Groups
are gathered in shards, whose suffixes are sorted by induced sorting: the sorted LMS suffixes
(found by recursion on their names) induce the L-type ones through queues, and these the S-type ones;
the queues are ordered by first symbol and order of arrival, and go to disk beyond a bound of memory.
Neighbours in suffix order that share ``width`` bytes are repeated windows.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, table, text_batches

WIDTH, GRAM = 200, 64
#: Bytes aimed at in a shard, and the most of one group; a larger one is split by content.
SHARD, MOST = 1 << 20, 4 << 20
#: Symbols that the queues of one shard hold in memory.
HELD = 16 << 20
#: Texts are scanned in stretches of at most this many bytes, so that a place fits into 24 bits.
STRETCH = 1 << 23
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` (a power of 2) bytes, by doubling."""
    out, width, factor = data.astype("uint64") + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < k:
        out = out[: len(out) - width] * factor + out[width:]
        factor, width = np.multiply(factor, factor, dtype="uint64"), 2 * width
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def runs_of(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, digest, first, n, anchor) of the runs: n windows from ``first`` on with one anchor, so many bytes after ``first``; the digest is of the run's bytes and its anchor's offset."""
    parts = []
    for at in range(0, max(1, len(text) - width + 1), STRETCH):
        data = np.frombuffer(text, "u1")[at : at + STRETCH + width - 1]
        if len(data) < width:
            continue
        hashes = gram_hashes(data, GRAM)
        place = least_of_each(hashes & ~PLACE | np.arange(len(hashes), dtype="uint64"), width - GRAM + 1) & PLACE
        first = np.flatnonzero(np.diff(place, prepend=PLACE))
        n = np.diff(np.append(first, len(place)))
        anchor = place[first].astype("int64")
        digests = [xxhash.xxh3_64_intdigest(text[a : a + m + width - 1], seed=o) for a, m, o in zip((first + at).tolist(), n.tolist(), (anchor - first).tolist(), strict=True)]
        parts.append((hashes[anchor], np.array(digests, "uint64"), first + at, n, anchor - first))
    if not parts:
        return tuple(np.zeros(0, t) for t in ("uint64", "uint64", "int64", "int64", "int64"))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Queues:
    """Queues of places, one for each symbol; what arrives when ``HELD`` places are in memory is kept in a file."""

    def __init__(self):
        self.parts, self.held, self.file = defaultdict(list), 0, None

    def put(self, symbols: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for symbol, part in zip(symbols[np.append(0, cuts)].tolist() if len(symbols) else [], np.split(places, cuts), strict=False):
            if self.held + len(part) > HELD and len(part) > 1000:
                self.file = self.file or tempfile.TemporaryFile()
                self.file.seek(0, 2)
                self.parts[symbol].append((self.file.tell(), len(part)))
                part.tofile(self.file)
            else:
                self.held += len(part)
                self.parts[symbol].append(part)

    def get(self, symbol: int, k: int = 0) -> np.ndarray:
        """What arrived for the symbol, from the ``k``-th part on."""
        out = []
        for part in self.parts[symbol][k:]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, "int64", part[1])
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, "int64")


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes, from that of the LMS suffixes ``seeds``. small: which places are of S-type."""

    def pass_on(queues: Queues, places: np.ndarray, kind: bool) -> None:
        before = places[places > 0] - 1
        before = before[small[before] == kind]
        queues.put(text[before], before)

    larger, smaller = Queues(), Queues()
    symbols = np.unique(text).tolist()
    cuts = np.searchsorted(text[seeds], np.append(symbols, symbols[-1] + 1))
    for c, a, b in zip(symbols, cuts, cuts[1:], strict=False):
        k = 0
        while k < (have := len(larger.parts[c])):  # what starts with a repeated symbol comes back to its own queue
            pass_on(larger, larger.get(c, k), False)
            k = have
        pass_on(larger, seeds[a:b], False)
    last = np.array([len(text) - 1])
    smaller.put(text[last], last)
    for c in reversed(symbols):
        k = 0
        while k < (have := len(smaller.parts[c])):
            pass_on(smaller, smaller.get(c, k), True)
            k = have
        pass_on(smaller, larger.get(c)[::-1], True)
    return np.concatenate([x for c in symbols for x in (larger.get(c), smaller.get(c)[::-1])])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of ``text`` by ``depth`` symbols at least; its last symbol is its least and occurs once."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    change = np.append(np.flatnonzero(np.diff(text)), n - 1)  # the last place of each stretch of equal symbols
    rises = np.append(text[change[:-1]] < text[change[1:]], True)
    small = np.repeat(rises, np.diff(change, prepend=-1))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) == 1:
        return induce(text, small, lms)
    rough = lms[np.argsort(text[lms], kind="stable")]
    order = induce(text, small, rough)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # names: neighbours in this order are equal if their LMS substrings are
    length = np.zeros(n, "int64")
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (k < length[a[live]])]
    names = np.zeros(n, "int64")
    names[order] = np.append(0, np.cumsum(~same))
    return induce(text, small, lms[np.argsort(doubled(names[lms], lms, depth), kind="stable")])


def doubled(names: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a reduced text by ``depth`` symbols of the text at least, from the names of its symbols and their places.

    Each round ranks twice as many names, of those suffixes that share their rank with others and reach less far than
    ``depth``. Suffixes that share a rank reach equally far, since equal names stand for equal strings.
    """

    def changes(x: np.ndarray) -> np.ndarray:
        return np.append(True, x[1:] != x[:-1])

    def first_places(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    n, step = len(names), 1
    open_ = np.argsort(names, kind="stable")
    new = changes(names[open_])
    rank = np.empty(n, "int64")  # a rank is the place of its first member, so ranks of others stay as they are
    rank[open_] = first_places(new)
    while True:
        open_ = open_[~(new & np.append(new[1:], True))]
        ahead = np.minimum(open_ + step, n - 1)
        open_ = open_[(open_ + step >= n) | (places[ahead] - places[open_] < depth)]
        if not len(open_) or step >= n:
            return rank
        base, inside = rank[open_], open_ + step < n
        next_ = np.where(inside, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        by = np.argsort(base * (n + 1) + next_)
        open_, base, next_ = open_[by], base[by], next_[by]
        group = changes(base)
        new = group | changes(next_)
        rank[open_] = base + first_places(new) - first_places(group)
        step *= 2


def repeated_windows(runs: list[bytes], width: int) -> list[np.ndarray]:
    """For each of some different byte strings, the starts of the windows that occur twice or more in all of them."""
    # a symbol of 0 ends each string; the end of all is a lesser one
    text = np.concatenate([x for r in runs for x in (np.frombuffer(r, "u1").astype("int64") + 2, [1])] + [[0]])
    sizes = np.array([len(r) + 1 for r in runs])
    ends = np.cumsum(sizes)
    order = suffix_order(text, width)
    order = order[order < ends[-1]]
    owner = np.searchsorted(ends, order, "right")
    fits = order + width < ends[owner]
    order, owner = order[fits], owner[fits]
    live = np.arange(len(order) - 1)
    for k in range(width):
        live = live[text[order[live] + k] == text[order[live + 1] + k]]
    hit = np.zeros(len(order), bool)
    hit[live] = hit[live + 1] = True
    places = np.sort(order[hit])
    whose = np.searchsorted(ends, places, "right")
    cuts = np.searchsorted(whose, np.arange(1, len(runs)))
    return [p - (ends[k] - sizes[k]) for k, p in enumerate(np.split(places, cuts))]


def stretches(starts: np.ndarray) -> list[dict]:
    """Starts in a row as (first, n)."""
    if not len(starts):
        return []
    cuts = np.append(0, np.flatnonzero(np.diff(starts) > 1) + 1)
    return [{"first": int(starts[a]), "n": int(b - a)} for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True)]


def scan(text: Column, width: int) -> Column:
    """struct(n_bytes, runs): the runs of a text as five arrays."""

    @F.pandas_udf("struct<n_bytes: long, g: array<long>, s: array<long>, first: array<int>, n: array<int>, anchor: array<int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            g, s, *places = runs_of(t or b"", width)
            rows.append((len(t or b""), g.view("int64"), s.view("int64"), *(x.astype("int32") for x in places)))
        return pd.DataFrame(rows, columns=["n_bytes", "g", "s", "first", "n", "anchor"])

    return of(text.cast("binary"))


def sort_shard(width: int):
    def of(shard: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(list(shard["data"]), width)
        hits = [[{"first": h["first"] + o, "n": h["n"]} for h in stretches(f)] for f, o in zip(found, shard["off"], strict=True)]
        return shard[["g0", "s0"]].assign(hits=hits)

    return of


HALVES = "array<struct<g: long, s: long, off: int, n: int, anchor: int, low: int, high: int, data: binary>>"


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def halved(data: bytes, n: int, anchor: int, low: int, high: int, width: int) -> list[dict]:
    """The windows of a run in two halves, by where the anchor stands in them: at ``low`` to ``high`` - 1, of which each half has a part. Each with a
    digest (g) of the bytes that windows with the anchor there all hold, and one (s) of all its bytes. Equal windows go the same way."""
    out, middle = [], (low + high) // 2
    for lo, hi in ((middle, high), (low, middle)):
        # the anchor stands at ``anchor`` in the first window and one place earlier in each further one
        off, past = max(0, anchor - hi + 1), min(n, anchor - lo + 1)
        if off < past:
            own = data[off : past + width - 1]
            g = xxhash.xxh3_64_intdigest(data[anchor - lo : anchor - hi + 1 + width], seed=lo << 16 | hi)
            s = xxhash.xxh3_64_intdigest(own, seed=anchor - off)
            out.append({"g": signed(g), "s": signed(s), "off": off, "n": past - off, "anchor": anchor - off, "low": lo, "high": hi, "data": own})
    return out


def halves(width: int, *columns: str) -> Column:
    @F.pandas_udf(HALVES)
    def of(data: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([halved(d, *map(int, r), width) for d, *r in zip(data, *rest, strict=True)])

    return of(*columns)


def cut(text: bytes | None, spans, width: int) -> tuple[bytes, int]:
    """(what is left, removed runs) of a text without the windows of ``spans`` (first, n)."""
    text, kept, at, runs = text or b"", [], 0, 0
    removed_to = -1
    for first, n in sorted((x["first"], x["n"]) for x in ([] if spans is None else spans)):
        if first > removed_to:
            kept.append(text[at:first])
            runs += 1
        removed_to = max(removed_to, first + n - 1 + width)
        at = removed_to
    return b"".join([*kept, text[at:]]), runs


SPANS = "g0 long, s0 long, hits array<struct<first: int, n: int>>"


def open_groups(kinds: DataFrame, copies: Column, at: Column, width: int) -> DataFrame:
    """The groups (g, bytes) that hold different runs, some of which may be repeated in part only."""
    found = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.min(copies).alias("fewest"), F.sum(at + width - 1).alias("bytes"))
    return found.where("kinds > 1 and fewest = 1").select("g", "bytes")


def split_groups(runs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(hits, runs): the halves of runs (g0, s0, off, g, s, n, anchor, low, high, data) of groups too large for a task: those that are equal, as hits, and one of
    each kind of those that go on in smaller groups, with the bytes of these."""
    parts = runs.select("g0", "s0", F.col("off").alias("_off"), F.explode(halves(width, "data", "n", "anchor", "low", "high")).alias("x"))
    parts = settle(parts.select("g0", "s0", (F.col("_off") + F.col("x.off")).alias("off"), "x.g", "x.s", "x.n", "x.anchor", "x.low", "x.high", "x.data"))
    kinds = settle(parts.groupBy("g", "s").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min(F.struct("g0", "s0", "off")).alias("one")))
    equal = parts.join(kinds.where("copies > 1").select("g", "s"), ["g", "s"], "left_semi").select("g0", "s0", F.array(F.struct(F.col("off").alias("first"), "n")).alias("hits"))
    left = kinds.join(open_groups(kinds, F.col("copies"), F.col("n"), width), "g").select("g", "s", "bytes", "one.*")
    rest = parts.join(left, ["g", "s", "g0", "s0", "off"])
    return settle(equal), settle(rest.select("g0", "s0", "off", "g", "s", "n", "anchor", "low", "high", "data", "bytes"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Add kept (binary), n_bytes, n_removed and n_spans: each text without the bytes that a string of ``width``
    bytes covers which starts at any other place of the corpus, in the same text or another.

    Repeats are judged on the input. Null texts count as empty; texts shorter than ``width`` are kept whole; a
    text that overlaps itself loses all its repeats. Equal rows repeat each other. Texts are told apart by id
    and hash. What is kept may end within a character. Columns of these names are replaced, others may have any. ``width`` must be 65 or more.
    """
    if width <= GRAM:
        raise ValueError(f"width must be above {GRAM}")
    text_batches(df.sparkSession)
    df = df.drop("kept", "n_bytes", "n_removed", "n_spans")
    names = list(df.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(id_col).isNull().alias("n"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    scanned = settle(df.select(key.alias("key"), scan(text, width).alias("p")).select(F.monotonically_increasing_id().alias("rid"), "key", "p.*"))
    runs = scanned.select("rid", F.explode(F.arrays_zip("g", "s", "first", "n", "anchor")).alias("r")).select("rid", "r.*")
    repeated = settle(scanned.select(F.explode("g").alias("g")).groupBy("g").count().where("count > 1").select("g"))
    live = settle(runs.join(repeated, "g", "left_semi"))
    kinds = settle(live.groupBy("g", "s").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "first", "n", "anchor")).alias("at")))
    unsure = kinds.join(open_groups(kinds, F.col("copies"), F.col("at.n"), width), "g").select("g", "s", "bytes", "at.*")
    unsure = settle(unsure.join(scanned.select("rid", "key"), "rid"))
    pieces = df.select(key.alias("key"), text.cast("binary").alias("data")).join(unsure, "key")
    pieces = pieces.select(F.col("g").alias("g0"), F.col("s").alias("s0"), F.lit(0).alias("off"), "g", "s", "n", "anchor", F.lit(0).alias("low"), F.lit(width - GRAM + 1).alias("high"), F.expr(f"substring(data, first + 1, n + {width - 1})").alias("data"), "bytes")
    pieces = settle(pieces.dropDuplicates(["g", "s"]))
    hits = None
    while True:  # each round halves the windows of the runs in large groups; runs of one window are equal if their group is
        small = pieces.where(F.col("bytes") <= most)
        size = small.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
        sorted_ = small.select("g0", "s0", "off", "data", F.pmod(F.xxhash64("g"), F.lit(size // shard + 1)).alias("shard")).groupBy("shard").applyInPandas(sort_shard(width), SPANS)
        hits = sorted_ if hits is None else hits.unionByName(sorted_)
        large = pieces.where(F.col("bytes") > most)
        if large.isEmpty():
            break
        equal, pieces = split_groups(large, width)
        hits = hits.unionByName(equal)
    hits = settle(hits.where(F.size("hits") > 0).select(F.col("g0").alias("g"), F.col("s0").alias("s"), "hits"))
    whole = live.join(kinds.where("copies > 1").select("g", "s"), ["g", "s"], "left_semi").select("rid", "first", "n")
    part = live.join(hits, ["g", "s"]).select("rid", "first", F.explode("hits").alias("h")).select("rid", (F.col("first") + F.col("h.first")).alias("first"), F.col("h.n").alias("n"))
    spans = whole.unionByName(part).groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    own, gone, found = (fresh(names, f"_{x}") for x in ("key", "spans", "found"))
    spans = settle(spans.join(scanned.select("rid", "key"), "rid").select(F.col("key").alias(own), F.col("spans").alias(gone)).dropDuplicates([own]))

    @F.pandas_udf("struct<kept: binary, n_bytes: long, n_spans: long>")
    def rest(texts: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, all_spans, strict=True):
            kept, n = cut(t, s, width)
            rows.append((kept, len(t or b""), n))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_spans"])

    out = df.withColumn(own, key).join(spans, own, "left").withColumn(found, rest(text.cast("binary"), F.col(gone)))
    return out.select(*names, f"{found}.*").withColumn("n_removed", F.col("n_bytes") - F.octet_length("kept"))


def op7_suffix_dedup(spark, sf_dir):
    """All documents without the strings of 200 bytes that the corpus repeats."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

