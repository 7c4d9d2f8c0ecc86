"""Near-duplicate embeddings by a flat graph with robust pruning (Subramanya et al., 2019).

Different vectors are dealt to several overlapping cluster shards. Each shard builds a graph: the
nearest members of each vector, pruned so that no neighbour is kept that a closer one already leads to. The
adjacency lists of all shards are united, and in each shard every member searches the united
graph greedily from the medoid; once within range of its vector, the search expands all that is in
range. Where the united list of the best vector found leads out of the shard, the search goes on across shards, by
joins, until it finds nothing new. Links are verified in double precision. A shard hands on how many links each
member has and one link that leads towards the least member of its component, never the pairs. A brute-force audit of some
vectors measures recall; while it is below the target, the shards overlap more, up to a bound; what misses ``FLOOR`` there is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settle, table

#: Vectors aimed at in a cluster of its own, the most in one task, and the most that clusters are fitted on.
SHARD, MOST, SAMPLE = 400, 4_000, 20_000
#: Each vector is filed in its OVERLAP nearest clusters, or in log2 of the clusters if that is more, and in at most WIDER times as many. Of isolated pairs at a
#: cosine of 0.901 in 128 dimensions none of 20,000 shares no cluster with 50 clusters, 3 do with 5,000 (12 each); with 3 each it was 500 and 3,900.
OVERLAP, WIDER = 8, 4
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Search: how many of the best found are followed, and how many are expanded at once.
BEAM, AT_ONCE = 24, 4
#: The audit starts with AUDITED vectors and doubles them until ENOUGH have links, or up to ASKED; the recall is the mean over these. If none has any, AUDITED
#: vectors are taken for which the search found links. Below RECALL shards overlap more; below FLOOR there is no result.
AUDITED, ENOUGH, ASKED, RECALL, FLOOR = 256, 64, 4_096, 0.98, 0.9


def unit(vectors) -> np.ndarray:
    found = np.stack([np.asarray(v, "float64") for v in vectors])
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` nearest centres of each vector, a block of vectors at a time."""
    out = [np.argpartition(-(x[at : at + 256] @ centres.T), many - 1, 1)[:, :many] for at in range(0, len(x), 256)]
    return np.concatenate(out) if out else np.zeros((0, many), "int64")


def cluster(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of unit vectors, by spherical k-means from evenly chosen starts; many centres stay what they are, members of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype("int64")]
    for _ in range(rounds if k <= 1024 else 0):
        own = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def robust_prune(near: np.ndarray, sims: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """For each vector the neighbours kept of its pool ``near`` (with cosines ``sims``): the closest in turn, each
    removing those that are ``ALPHA`` times closer to it than to the vector."""
    n, pool = near.shape
    alive, kept = np.ones((n, pool), bool), [[] for _ in range(n)]
    away = np.sqrt(np.maximum(0, 2 - 2 * sims))
    for _ in range(min(DEGREE, pool)):
        best = np.where(alive, away, np.inf).argmin(1)
        rows = np.flatnonzero(alive[np.arange(n), best])
        if not len(rows):
            break
        chosen = near[rows, best[rows]]
        for r, c in zip(rows, chosen, strict=True):
            kept[r].append(c)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rpd,rd->rp", x[near[rows]], x[chosen])))
        alive[rows] &= ALPHA * between > away[rows]
        alive[rows, best[rows]] = False
    return [np.array(k, "int64") for k in kept]


def build(shard: pd.DataFrame) -> pd.DataFrame:
    """Adjacency (node, other) of one shard."""
    x, nodes = unit(shard["vector"]), shard["node"].to_numpy()
    n = len(x)
    if n < 2:
        return pd.DataFrame({"node": nodes[:0], "other": nodes[:0]})
    rng, pool = np.random.default_rng(n), min(POOL, n - 1)
    edges = []
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, pool - 1, 1)[:, :pool]
        # some far members keep the graph connected across dense regions
        near = np.concatenate([near, (rows[:, None] + rng.integers(1, n, (len(rows), 8))) % n], 1)
        for r, kept in zip(rows, robust_prune(near, np.take_along_axis(sims, near, 1), x), strict=True):
            edges += [(np.full(len(kept), r), kept)]
    a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
    return pd.DataFrame({"node": nodes[np.append(a, b)], "other": nodes[np.append(b, a)]}).drop_duplicates()


#: Cosines of unit vectors this near to the threshold are computed anew from the vectors as they are.
CLOSE = 1e-9


def search(x: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hits, best): which pairs have a cosine of ``least`` - CLOSE or more, of those that searches from the medoid find, all vectors side by side;
    and the nearest other vector that each search found, or -1."""
    n = len(x)
    count = np.array([len(o) for o in lists])
    begin, others = np.cumsum(count) - count, np.concatenate(lists)
    medoid = int((x @ x.mean(0)).argmax())
    hits, nearest_ = np.zeros((n, n), bool), np.full(n, -1)
    for at in range(0, n, 512):
        query = np.arange(at, min(n, at + 512))
        sims = np.full((len(query), n), -2.0)
        sims[:, medoid] = x[query] @ x[medoid]
        open_ = sims > -2
        live = np.arange(len(query))
        while len(live):
            found = np.where(open_[live], sims[live], -2)
            width = min(AT_ONCE, n)
            best = np.argpartition(-found, width - 1, 1)[:, :width]
            score = np.take_along_axis(found, best, 1)
            beam = -np.partition(-sims[live], min(BEAM, n) - 1, 1)[:, min(BEAM, n) - 1]
            take = (score > -2) & ((score >= beam[:, None]) | (score >= least - CLOSE))
            q, slot = np.nonzero(take)
            if not len(q):
                break
            row, node = live[q], best[q, slot]
            open_[row, node] = False
            many = count[node]
            reached = others[np.repeat(begin[node] + many - np.cumsum(many), many) + np.arange(many.sum())]
            whose = np.repeat(row, many)
            fresh_ = sims[whose, reached] == -2
            reached, whose = reached[fresh_], whose[fresh_]
            sims[whose, reached] = np.einsum("ed,ed->e", x[query[whose]], x[reached])
            open_[whose, reached] = True
            live = np.unique(row)
        sims[np.arange(len(query)), query] = -2
        top = sims.argmax(1)
        nearest_[query] = np.where(sims[np.arange(len(query)), top] > -2, top, -1)
        hits[query] = sims >= least - CLOSE
    return hits | hits.T, nearest_


def verified(hits: np.ndarray, x: np.ndarray, vectors: pd.Series, least: float) -> np.ndarray:
    """The hits without those that only rounding brought to the threshold."""
    for at in range(0, len(x), 512):
        a, b = np.nonzero(hits[at : at + 512])
        unsure = np.abs(np.einsum("ed,ed->e", x[at + a], x[b]) - least) <= 2 * CLOSE
        a, b = a[unsure], b[unsure]
        if len(a):
            hits[at + a, b] = cosine(vectors.iloc[at + a], vectors.iloc[b]) >= least
    return hits


def least_reached(hits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node that each one reaches by hits."""
    out, rest = nodes.copy(), np.ones(len(nodes), bool)
    for first in np.argsort(nodes):
        if rest[first]:
            rest[first], front = False, [first]
            while front:
                new = np.flatnonzero(hits[front.pop()] & rest)
                rest[new] = False
                out[new] = nodes[first]
                front += new.tolist()
    return out


FOUND = "node long, n long, root long, hits array<long>, far array<long>"


def linked(shard: pd.DataFrame, least: float, asked: np.ndarray) -> pd.DataFrame:
    """What one shard of (cluster, p, q, node, part, parts, clusters, copies, vector, others) knows of its members: the rows behind the links
    that are counted here (n), the least member reached (root), for audited vectors the links so counted (hits), and where the
    search would go on outside (far).

    Two members may meet in several shards. Their link is counted in the least cluster that both are in; there, members of
    different parts meet once, and those of one part are counted where the next part is the other one.
    """
    shard = shard.reset_index(drop=True)
    x, nodes = unit(shard["vector"]), shard["node"].to_numpy()
    place = {v: k for k, v in enumerate(nodes.tolist())}
    united = [np.array([] if o is None else o, "int64") for o in shard["others"]]
    lists = [np.array(sorted(place[o] for o in os.tolist() if o in place), "int64") for os in united]
    hits, best = search(x, lists, least)
    hits = verified(hits, x, shard["vector"], least)
    root = least_reached(hits, nodes)
    here, p, q, parts = (int(shard[c].iat[0]) for c in ("cluster", "p", "q", "parts"))
    homes, part = np.stack(shard["clusters"].to_list()), shard["part"].to_numpy()
    counts, copies = np.zeros(len(nodes), "int64"), shard["copies"].to_numpy()
    at_home = ((part == p) & ((p + 1) % parts == q)) | ((part == q) & ((q + 1) % parts == p)) if parts > 2 else np.ones(len(nodes), bool)
    earlier = np.where(homes < here, homes, -1)  # clusters before this one, that would count the link
    audited, none = np.isin(nodes, asked), np.zeros(0, "int64")
    listed = [none] * len(nodes)
    for k in np.flatnonzero(hits.any(1)):
        mine = np.flatnonzero(hits[k])
        first = earlier[k][earlier[k] >= 0]
        before = np.isin(homes[mine], first).any(1) if len(first) else np.zeros(len(mine), bool)
        mine = mine[~before & ((part[mine] != part[k]) | at_home[k])]
        counts[k] = copies[mine].sum()
        if audited[k]:
            listed[k] = nodes[mine]
    far = [none] * len(nodes)
    for k in np.flatnonzero(hits.any(1)):
        outside = np.unique(np.concatenate([united[k], united[best[k]]]))
        far[k] = outside[[o not in place for o in outside.tolist()]]
    return pd.DataFrame({"node": nodes, "n": counts, "root": root, "hits": listed, "far": far})


def cosine(a, b) -> np.ndarray:
    a, b = (np.stack([np.asarray(v, "float64") for v in s]) for s in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def searched(classes: DataFrame, least: float, overlap: int, centres: np.ndarray, asked: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, homes, united) of different vectors (node, vector, copies), each filed in ``overlap`` clusters: what the shards found (FOUND), the
    clusters of each node, and the united adjacency lists."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)

    def deal(batches):
        for batch in batches:
            if len(batch):
                near = np.sort(nearest(unit(batch["vector"]), sent.value, overlap), 1).astype("int32")
                yield batch.assign(clusters=list(near))

    homes = settle(classes.select("node", "copies", "vector").mapInPandas(deal, "node long, copies long, vector array<double>, clusters array<int>"))
    dealt = homes.select(F.explode("clusters").alias("cluster"), "node", "copies", "vector", "clusters")
    # a cluster that outgrows a task is cut in parts, and every two parts meet in a task of their own
    parts = dealt.groupBy("cluster").agg(F.ceil(F.count("*") / (MOST / 2)).cast("int").alias("parts"))
    dealt = dealt.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meet = F.when(F.col("parts") <= 2, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")), lambda p: F.struct(F.least(p, F.col("part")).alias("p"), F.greatest(p, F.col("part")).alias("q")))
    )
    shards = settle(dealt.withColumn("m", F.explode(meet)).select("cluster", "m.p", "m.q", "node", "part", "parts", "clusters", "copies", "vector"))
    by = ["cluster", "p", "q"]
    edges = shards.select(*by, "node", "vector").groupBy(*by).applyInPandas(build, "node long, other long")
    united = settle(edges.groupBy("node").agg(F.collect_set("other").alias("others")))
    found = shards.join(united, "node", "left").groupBy(*by).applyInPandas(lambda g: linked(g, least, asked), FOUND)
    return settle(found), homes, united


def across(pairs: DataFrame, homes: DataFrame, least: float) -> DataFrame:
    """The links (a, b) among pairs of nodes that share no cluster, verified."""
    one = lambda name: homes.select(F.col("node").alias(name), F.col("clusters").alias(f"c{name}"))
    apart = pairs.where("a < b").distinct().join(one("a"), "a").join(one("b"), "b").where(~F.arrays_overlap("ca", "cb")).select("a", "b")
    both = settle(apart)
    vector = lambda name: homes.select(F.col("node").alias(name), F.col("vector").alias(f"v{name}"))

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(cosine(x, y) >= least) if len(x) else pd.Series([], dtype=bool)

    return both.join(vector("a"), "a").join(vector("b"), "b").where(near("va", "vb")).select("a", "b")


def links_across(found: DataFrame, homes: DataFrame, united: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between vectors that share no cluster: searches go on along the united lists of what they find there."""
    start = found.select("node", F.explode("far").alias("o"))
    links = settle(across(start.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")), homes, least))
    new = links
    while not new.isEmpty():
        ends = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = ends.join(united.withColumnRenamed("node", "b"), "b").select("a", F.explode("others").alias("o"))
        new = across(more.select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b")).join(links, ["a", "b"], "left_anti"), homes, least)
        new = settle(new)
        links = links.unionByName(new)
    return links


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per row of ``df``: (id, n_links, component_id, kept, recall).

    n_links: other rows with a cosine of ``least`` or more; component_id: the least id that links reach; kept:
    whether that is the row's own. Equal vectors are one class, linked with each other and never compared;
    links between classes count the rows behind them. recall: the least that the audits of this run measured, null where no vector
    links with a different one. Vectors that are null, empty or zero or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths with each other. Rows with a
    null id count as links, but name a component only if it has no other id; ids may repeat. Other columns do not matter; an empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).withColumn("usable", usable(F.col("vector")))
    rows = settle(rows)
    classes = rows.where("usable").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector")))
    counts = links = None
    measured = []
    for (width,) in classes.select("width").distinct().collect():
        own = classes.where(F.col("width") == width)
        n, l, reached = links_of(own, least)
        measured += [] if reached is None else [reached]
        counts, links = (n, l) if counts is None else (counts.unionByName(n), links.unionByName(l))
    if counts is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("recall"))
    others = counts.groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(links)
    classes = classes.join(others, "node", "left").join(roots, "node", "left").select("vector", "id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    classes = settle(classes)
    named = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = classes.join(named, "root").select("vector", "n_links", "component_id")
    linked_rows = rows.where("usable").join(settle(classes), "vector").select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), F.lit(min(measured, default=None)).cast("double").alias("recall"))


def links_of(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame, float | None]:
    """(counts, links, recall) of different vectors of one length: rows behind the links of each node (node, n), to be summed, links (a, b) that
    connect what links connect, and the recall that was measured, None if nothing links. Shards overlap more until the audit is content."""
    count = classes.count()
    sample = classes.select("node", "vector").orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).toPandas()
    overlap = max(OVERLAP, math.ceil(math.log2(max(1, count / SHARD))))
    k = max(1, min(round(count * overlap / OVERLAP / SHARD), len(sample)))
    centres = cluster(unit(sample["vector"]), k)
    overlap, most = min(k, overlap), min(k, overlap * WIDER)
    asked, truth = audited(classes, sample, least)
    while True:
        found, homes, united = searched(classes, least, overlap, centres, asked)
        far = links_across(found, homes, united, least)
        if truth.isEmpty():
            linked_ = found.where("n > 0").select("node").unionByName(far.select(F.col("a").alias("node"))).distinct().orderBy(F.xxhash64("node")).limit(AUDITED)
            some = classes.select("node", "vector").join(linked_, "node").toPandas()
            if some.empty:
                reached = None
                break
            asked, truth = some["node"].to_numpy(), true_links(classes, some, least)
            continue
        reached = recall(found, far, truth)
        if reached >= RECALL or overlap == most:
            break
        overlap = min(most, 2 * overlap)
    if reached is not None and reached < FLOOR:
        raise RuntimeError(f"searches find {reached:.3f} of the links with each vector in {overlap} of {k} clusters")
    both = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
    links = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(far)
    return found.where("n > 0").select("node", "n").unionByName(beyond), links, reached


def true_links(classes: DataFrame, asked: pd.DataFrame, least: float) -> DataFrame:
    """All links (a, b) of the vectors asked for (a bounded number), by comparing them with all, in blocks."""
    sent = classes.sparkSession.sparkContext.broadcast((asked["node"].to_numpy(), unit(asked["vector"])))

    def true(batches):
        nodes, x = sent.value
        for batch in batches:
            if len(batch):
                q, b = np.nonzero(x @ unit(batch["vector"]).T >= least)
                a, b = nodes[q], batch["node"].to_numpy()[b]
                yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return settle(classes.select("node", "vector").mapInPandas(true, "a long, b long"))


def audited(classes: DataFrame, sample: pd.DataFrame, least: float) -> tuple[np.ndarray, DataFrame]:
    """(nodes, truth): some vectors and all their true links (a, b)."""
    many = AUDITED
    while True:
        asked = sample.iloc[:many]
        truth = true_links(classes, asked, least)
        if many >= min(ASKED, len(sample)) or truth.select("a").distinct().count() >= ENOUGH:
            return asked["node"].to_numpy(), truth
        many *= 2


def recall(found: DataFrame, far: DataFrame, truth: DataFrame) -> float:
    """The mean share of their true links that audited vectors with links have found."""
    got = found.select(F.col("node").alias("a"), F.explode("hits").alias("b")).unionByName(far).unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    share = truth.join(got.withColumn("found", F.lit(1)), ["a", "b"], "left").groupBy("a").agg((F.count("found") / F.count("*")).alias("share"))
    return share.agg(F.avg("share")).first()[0]


def op8_embedding_graph(spark, sf_dir):
    """Links of all embeddings at a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
