"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, then confirmed on full sets.

A text's set are its distinct 4-word shingles, as 64-bit hashes. Register j of its sketch holds
floor(1 - log_b x) cut to 0..TOP, where x is the smallest of the shingles' exponential hashes under function j: minima on an
exponentially spaced scale, so the sketch of a union is the greater of both registers, and two registers are equal with a
probability close to the Jaccard similarity. Equal sets are one node. BANDS bands of WIDTH registers each are the bucket
keys: a link of similarity 0.8 meets in none of them with a probability of (1 - 0.8^4)^32, that is 5e-8. The registers that are greater,
less and equal give the likelihood of every similarity (with the set sizes known); a pair goes if 0.8 is less likely
than the best estimate by over exp(RATIO / 2), which costs a true link about 3e-10. What is left is intersected.

No bucket lists all its pairs. First each node meets the hub of each of its buckets, the node that most others meet, and
what links is one component. Only buckets that still hold several components go on: small ones pair across components,
large ones are dealt as blocks against blocks, whose tasks compare and intersect by themselves and return links only.

Defined cases: null text, empty text and text without words have an empty set and are linked with nothing; fewer than 4
words are one shingle; rows with the same id and text are returned each; a component whose ids are all null has component
null (and kept null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, written
from .simhash import Forest, connected

SHINGLE, PERCENT = 4, 80
BANDS, WIDTH = 32, 4
REGISTERS = BANDS * WIDTH
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
RATIO = 40.0           # twice the log likelihood ratio beyond which a pair can't be a link
FLOOR = REGISTERS // 2 # with fewer equal registers the ratio is always beyond that: no need to work it out
SMALL = 32             # nodes of a bucket that are paired without blocks
BLOCK = 1_000          # nodes of a block of a larger bucket
STEP = 512             # shingles hashed at once
FACTORS = np.random.default_rng(13).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[-n:] if len(words) >= SHINGLE else ends[-1:]
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    return np.unique(np.fromiter(map(hashed, parts), np.uint64, n))


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(members), STEP):
        least = np.minimum(least, (members[at:at + STEP, None] * FACTORS).min(axis=0))
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) * 2.0 ** -64, 1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def _win(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater, for the share of the joint set that only its own set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, target: float = PERCENT / 100) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity, from the registers that are greater and less, and whether `target` or more may be true."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        def log_likelihood(j: np.ndarray) -> np.ndarray:
            up, down = _win(u - v * j), _win(v - u * j)
            total = np.zeros(np.broadcast_shapes(u.shape, j.shape))
            for count, p in ((more, up), (less, down), (REGISTERS - more - less, 1 - up - down)):
                total = total + np.where(count[:, None] > 0, count[:, None] * np.log(np.maximum(p, 1e-300)), 0.0)
            return np.where(j <= np.minimum(u / v, v / u) + 1e-12, total, -np.inf)
        all_of, at_target = log_likelihood(grid), log_likelihood(np.full((1, 1), target))[:, 0]
    best = all_of.argmax(axis=1)
    top = np.maximum(all_of[np.arange(len(best)), best], at_target)
    return grid[0, best], (grid[0, best] >= target) | (2 * (top - at_target) <= RATIO)


def _matrix(regs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, regs)), "<u2").reshape(-1, REGISTERS)


@F.pandas_udf(T.DoubleType())
def _alike(regs_a: pd.Series, regs_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """The estimated similarity; null where the likelihood rules a link out."""
    a, b = _matrix(regs_a), _matrix(regs_b)
    out = np.full(len(a), np.nan)
    some = np.flatnonzero((a == b).sum(axis=1) >= FLOOR)
    if len(some):
        a, b = a[some], b[some]
        est, may = estimate((a > b).sum(axis=1), (a < b).sum(axis=1), n_a.to_numpy(float)[some], n_b.to_numpy(float)[some])
        out[some] = np.where(may, est, np.nan)
    return pd.Series([None if x != x else x for x in out.tolist()], dtype=object)


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)


def _sized(a: str, b: str) -> Column:
    """Whether set sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit("second")).alias("k2")]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (of the text), n (set size), s1, s2 (of the set), regs; one row per row of `docs`."""

    names = ["n", "s1", "s2", "regs"]

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows = []
            for text in p["text"]:
                found = shingles(text.as_py())
                raw = found.tobytes()
                rows.append((len(found), *(xxhash.xxh64_intdigest(raw, seed) - (1 << 63) for seed in (1, 2)), registers(found).tobytes()))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([p["doc_id"], p["k1"], p["k2"], *made], names=["doc_id", "k1", "k2", *names])

    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), *_text_keys(), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, k1 bigint, k2 bigint, n bigint, s1 bigint, s2 bigint, regs binary")


def nodes_of(prints: DataFrame) -> DataFrame:
    """node, n, regs, first (smallest id), like (id and text keys of one row): the distinct sets that are not empty."""
    sets = prints.filter("n > 0").groupBy("s1", "s2").agg(
        F.first("n").alias("n"), F.first("regs").alias("regs"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "k1", "k2")).alias("like"))
    return written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")


def bands(nodes: DataFrame) -> DataFrame:
    """node, band, key: one row per band."""
    bits = 2 * WIDTH
    return nodes.select("node", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {bits} + 1, {bits})))")).alias("band", "key"))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, alike: the pairs (a, b) whose sizes and sketches allow a link."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}")), side)
        if side == "b":
            pairs = pairs.filter(_sized("n_a", "n_b"))
    return pairs.select("a", "b", _alike("regs_a", "regs_b", "n_a", "n_b").alias("alike")).filter("alike is not null")


class Links:
    """The components that confirmed links make, grown batch by batch."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, wanted: DataFrame):
        """`wanted`: the nodes (distinct) that may have links. Their sets are read again, once, from one text each."""
        self.roots = docs.sparkSession.createDataFrame([], "node bigint, root bigint")
        wanted = wanted.join(nodes, "node").select("node", F.col("like.doc_id").alias("w_id"), F.col("like.k1").alias("w1"), F.col("like.k2").alias("w2"))
        rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *_text_keys())
        match = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
        rows = rows.join(wanted, match).select("node", F.col("text").cast("binary").alias("text"))

        def members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                found = [shingles(t.as_py()) for t in p["text"]]
                yield pa.RecordBatch.from_arrays([p["node"], pa.array([len(f) for f in found], pa.int64()),
                                                  pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "n", "members"])

        self.sets = written(rows.mapInArrow(members, "node bigint, n bigint, members binary").dropDuplicates(["node"]), "sets")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs in different components."""
        for side in "ab":
            pairs = pairs.join(self.roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")

    def test(self, pairs: DataFrame) -> None:
        """Confirm candidates (a, b, alike). Each b tries its two likeliest partners first; the others are tested only where
        that has not made one component of them."""
        place = "row_number() over (partition by b order by alike desc, a)"
        pairs = written(pairs.withColumn("place", F.expr(place)), "candidates")
        if pairs.isEmpty():
            return
        self._confirm(pairs.filter("place <= 2").select("a", "b"))
        rest = written(self.apart(pairs.filter("place > 2").select("a", "b")), "rest")
        if not rest.isEmpty():
            self._confirm(rest)

    def _confirm(self, pairs: DataFrame) -> None:
        for side in "ba":
            pairs = pairs.join(self.sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("members").alias(f"m_{side}")), side)
        shared = pairs.select("a", "b", "n_a", "n_b", _common("m_a", "m_b").alias("both"))
        self.add(shared.filter(100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        """Links among the components so far; the nodes below them are mapped once more."""
        links = written(links, "links")
        if links.isEmpty():
            return
        for side in "ab":
            links = links.join(self.roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        over = connected(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
        above = over.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        moved = self.roots.join(above, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root"))
        fresh = over.join(self.roots.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
        self.roots = written(moved.unionByName(fresh), "roots")


def _open_buckets(rows: DataFrame, links: Links) -> DataFrame:
    """key, band, node, root, size: the bucket rows whose buckets hold several components apart from what their hub met."""
    rooted = rows.join(links.roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select(
        "key", "band", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    return rooted.join(several.select("key", "size"), "key")


def _block_links(opened: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the links across components in large buckets, found block against block; a task returns a spanning forest.

    A pair belongs to the first band that it meets in, so no pair is compared twice. Registers rule out most pairs; the sets
    of the others are intersected at once, so that pairs which are close but not linked never leave their task.
    """
    dealt = opened.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    dealt = dealt.join(nodes.select("node", "n", "regs"), "node").join(sets.select("node", "members"), "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, band = (rows[c].iloc[0] for c in ("i", "j", "band"))
        rows = rows.sort_values(["own", "node"], kind="stable")
        regs, n, node = _matrix(rows["regs"]), rows["n"].to_numpy(), rows["node"].to_numpy()
        _, root = np.unique(rows["root"].to_numpy(), return_inverse=True)
        right = np.flatnonzero(rows["own"].to_numpy() == j)
        forest = Forest(int(root.max()) + 1)
        top = forest.roots()
        # Shingles as places in the list of those that this task holds more than once.
        sizes = np.array([len(m) // 8 for m in rows["members"]])
        everything = np.frombuffer(b"".join(map(bytes, rows["members"])), "<u8")
        _, place, often = np.unique(everything, return_inverse=True, return_counts=True)
        starts, seen = np.cumsum(sizes) - sizes, np.zeros(len(often), bool)
        found = []
        for x in np.flatnonzero(rows["own"].to_numpy() == i):
            y = right[right > x] if i == j else right
            y = y[(top[root[y]] != top[root[x]]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))]
            same = regs[x] == regs[y]
            keep = (same.sum(axis=1) >= FLOOR) & (same.reshape(-1, BANDS, WIDTH).all(axis=2).argmax(axis=1) == band)
            y = y[keep]
            if not len(y):
                continue
            _, may = estimate((regs[x] > regs[y]).sum(axis=1), (regs[x] < regs[y]).sum(axis=1), np.full(len(y), float(n[x])), n[y].astype(float))
            y = y[may]
            if not len(y):
                continue
            own = place[starts[x]:starts[x] + sizes[x]]
            seen[own] = True
            at = np.repeat(starts[y], sizes[y]) + np.arange(sizes[y].sum()) - np.repeat(np.cumsum(sizes[y]) - sizes[y], sizes[y])
            both = np.add.reduceat(seen[place[at]].astype(np.int64), np.cumsum(sizes[y]) - sizes[y])
            seen[own] = False
            y = y[100 * both >= PERCENT * (n[x] + n[y] - both)]
            if len(y):
                _, first = np.unique(top[root[y]], return_index=True)       # one link to each component
                found += [(node[k], node[x]) for k in y[first]]
                forest.union(np.full(len(y), root[x]), root[y])
                top = forest.roots()
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    # Few bytes that take long: their tasks are not to be put together by size.
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def stars(rows: DataFrame) -> DataFrame:
    """key, node, hub, size of every bucket with several nodes, its hub apart: the node that meets most others, over all its
    buckets, as the original of many copies does."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(rows.join(sizes, "key"), "shared")
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.least")).alias("hub"))
    return written(shared.join(hubs, "key").filter("node != hub"), "stars")


def link(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of all nodes that are linked with another one."""
    shared = stars(written(bands(nodes), "bands"))
    met = shared.select("node").distinct().unionByName(shared.select(F.col("hub").alias("node")).distinct()).distinct()
    links = Links(docs, nodes, met)
    links.test(_plausible(shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes))
    rest = shared.filter("size > 2").select("key", "band", "node")      # two nodes have met already
    opened = written(_open_buckets(rest, links), "open").filter(F.col("size") <= SMALL)
    left = opened.select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
    right = opened.select("key", F.col("node").alias("b"), F.col("root").alias("rb"))
    across = left.join(right, "key").filter("a < b and ra != rb").select("a", "b").distinct()
    links.test(_plausible(across, nodes))
    opened = written(_open_buckets(rest, links).filter(F.col("size") > SMALL), "open")
    if not opened.isEmpty():
        links.add(_block_links(opened, nodes, links.sets))
    return links.roots


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of `docs`."""
    prints = written(sketches(docs), "setsketch")
    nodes = nodes_of(prints)
    roots = link(docs, nodes).withColumnRenamed("node", "r_node")
    owned = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), "first", F.coalesce("root", "node").alias("root"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    owned = owned.join(least, "root").select("c1", "c2", "component_id")
    full = prints.filter("n > 0").join(owned, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select("doc_id", "n", "component_id")
    alone = prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                          (F.col("doc_id") == F.col("component_id")).alias("kept"))
