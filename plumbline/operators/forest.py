"""Forests of regression trees for several targets at once, over rows of bin numbers.

Every tree splits a node where the squared errors of all targets together fall most. Equal bin vectors are one weighted
row. Each tree's bootstrap draws how often a vector's rows come up from a Poisson distribution with the number of rows as
its mean, which is the sum of that many single draws: the law does not depend on how rows are combined.

Trees grow level by level. While a node holds many vectors, one Spark aggregate per level counts all such nodes of all
trees by feature and bin, and the best cuts follow from the counts. Nodes of at most `local` vectors are grown to their
end by one task each, again level by level, on arrays.

A tree has at most twice as many nodes as there are distinct vectors, and the bins bound those. Finished subtrees are
written by the tasks that grow them, into the folder all executors share. Nobody holds a whole forest: scoring reads one
subtree after the other, for many rows at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import materialize, quoted, shared_dir

LOCAL = 50_000          # vectors of a node that one task grows
PASS = 1_000_000        # rows that are scored while the trees are read once
# A subtree below node `top` of the upper part: feature -1 is a leaf, whose `low` is its place in `leaf`; else the children
# are low and low + 1. `gains` is what its cuts take away, per feature.
SUBTREES_SCHEMA = "tree int, top int, feature array<int>, cut array<int>, low array<int>, leaf array<double>, gains array<double>"


# -- splitting, shared by the aggregated and the local levels ----------------------------------------

def best_cuts(counts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut (the last bin that goes low) and gain of each node; feature -1 where it can't be split.

    counts: node, feature, bin, then (weight, sum of each target); active: nodes that are not pure.
    """
    n, features, bins, _ = counts.shape
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    whole = counts.sum(axis=2)[:, :, None]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left[..., 1:] ** 2).sum(-1) / left[..., 0] + (right[..., 1:] ** 2).sum(-1) / right[..., 0]
                - (whole[..., 1:] ** 2).sum(-1) / whole[..., 0])
    gain = np.where((left[..., 0] > 0.5) & (right[..., 0] > 0.5) & active[:, None, None], gain, -np.inf).reshape(n, -1)
    if not gain.shape[1]:
        return np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    best = gain.argmax(axis=1)              # the first of equal gains
    top = gain[np.arange(n), best]
    found = np.isfinite(top)
    return np.where(found, best // (bins - 1), -1), np.where(found, best % (bins - 1), 0), np.where(found, np.maximum(top, 0.0), 0.0)


def count_cells(bins: np.ndarray, weight: np.ndarray, targets: np.ndarray, node: np.ndarray, n_nodes: int, n_bins: int) -> np.ndarray:
    """The counts `best_cuts` needs: (node, feature, bin, 1 + targets)."""
    out = np.zeros((n_nodes, bins.shape[1], n_bins, 1 + targets.shape[1]))
    for f in range(bins.shape[1]):
        at = node * n_bins + bins[:, f]
        for k, w in enumerate([weight, *(weight * targets[:, m] for m in range(targets.shape[1]))]):
            out[:, f, :, k] = np.bincount(at, w, n_nodes * n_bins).reshape(n_nodes, n_bins)
    return out


def grow(bins: np.ndarray, weight: np.ndarray, targets: np.ndarray, depth: int, n_bins: int) -> dict[str, np.ndarray]:
    """A whole tree on arrays: feature (-1: leaf), cut, low, high, gain, value per node, the root first."""
    kept = weight > 0
    bins, weight, targets = bins[kept], weight[kept], targets[kept]
    node = np.zeros(len(weight), np.int64)
    parts: dict[str, list] = {k: [] for k in ("feature", "cut", "low", "high", "gain", "value")}
    level = 0
    base, width = 0, 1
    while width:
        total = np.bincount(node, weight, width)
        value = np.stack([np.bincount(node, weight * targets[:, m], width) / total for m in range(targets.shape[1])], axis=1)
        flat = np.ones(width, bool)
        for m in range(targets.shape[1]):
            lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
            np.minimum.at(lo, node, targets[:, m])
            np.maximum.at(hi, node, targets[:, m])
            flat &= hi - lo <= 1e-12 * np.maximum(1.0, np.abs(hi))
        feature, cut, gain = np.full(width, -1), np.zeros(width, np.int64), np.zeros(width)
        if level < depth:
            step = max(1, 20_000_000 // max(1, bins.shape[1] * n_bins * (1 + targets.shape[1])))   # nodes whose counts are held at once
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange(0, width + step, step))
            for i, at in enumerate(range(0, width, step)):
                some, size = order[ends[i]:ends[i + 1]], min(step, width - at)
                counts = count_cells(bins[some], weight[some], targets[some], node[some] - at, size, n_bins)
                feature[at:at + size], cut[at:at + size], gain[at:at + size] = best_cuts(counts, ~flat[at:at + size])
        split = feature >= 0
        child = base + width + 2 * (np.cumsum(split) - 1)
        for k, x in (("feature", feature), ("cut", cut), ("low", np.where(split, child, -1)), ("high", np.where(split, child + 1, -1)),
                     ("gain", gain), ("value", value)):
            parts[k].append(x)
        on = split[node]
        bins, weight, targets, node = bins[on], weight[on], targets[on], node[on]
        high = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = child[node] - base - width + high
        base, width, level = base + width, 2 * int(split.sum()), level + 1
    return {k: np.concatenate(v) for k, v in parts.items()}


# -- the bootstrap -----------------------------------------------------------------------------------

def draws(keys: Sequence[int], weights: Sequence[float], trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each vector: Poisson with the vector's number of rows as mean, the same on every run."""
    out = np.zeros((len(keys), trees), np.int64)
    for i, (key, w) in enumerate(zip(keys, weights)):
        stream = np.random.Generator(np.random.Philox(key=[seed & (2 ** 64 - 1), int(key) & (2 ** 64 - 1)]))
        out[i] = stream.poisson(w, trees)
    return out


def with_draws(vectors: DataFrame, bins: Sequence[str], trees: int, seed: int) -> DataFrame:
    """Adds __draws, one count per tree, to rows with a weight column __w. Equal vectors must be combined."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(key: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series(list(draws(key, weight, trees, seed)))

    return vectors.withColumn("__draws", draw(F.xxhash64(*bins), F.col("__w").cast("double")))


# -- the forest --------------------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees as arrays, one after the other; children are counted within a tree."""

    bins: list[str]
    targets: list[str]
    start: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf (row, tree) of each bin vector."""
        at = np.broadcast_to(self.start, (len(rows), len(self.start))).copy()
        base = at.copy()
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            i, _ = np.nonzero(inner)
            here = at[inner]
            low = rows[i, f[inner]] <= self.cut[here]
            at[inner] = base[inner] + np.where(low, self.low[here], self.high[here])

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees, per row and target. Equal rows are looked up once."""
        distinct, place = np.unique(rows, axis=0, return_inverse=True)
        out = np.zeros((len(distinct), len(self.targets)))
        for at in range(0, len(distinct), 2_000):
            out[at:at + 2_000] = self.value[self.leaves(distinct[at:at + 2_000])].mean(axis=1)
        return out[place.reshape(-1)]

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredForest:
        return StoredForest.load(spark, path)


@dataclass
class StoredForest:
    """Trees in a folder that the driver and all executors can read, one folder per tree and one row per subtree.

    The driver holds their upper parts, which end where one task can grow the rest.
    """

    bins: list[str]
    targets: list[str]
    path: str
    trees: list[int]
    tops: _Tops
    gains: list[list[float]]          # per tree, per feature
    asked: int = 0                    # trees it was grown with; one that drew no row is left out

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees, per row and target. Equal rows are looked up once; one subtree is held at a time."""
        distinct, place = np.unique(np.asarray(rows, np.int32), axis=0, return_inverse=True)
        out = np.zeros((len(distinct), len(self.targets)))
        for tree in self.trees:
            at = self.tops.place(tree, distinct)
            for top, feature, cut, low, leaf in _subtrees(self.path, tree):
                here = np.flatnonzero(at == top)
                if len(here):
                    out[here] += leaf.reshape(-1, len(self.targets))[_leaf(feature, cut, low, distinct[here])]
        return (out / max(1, len(self.trees)))[place.reshape(-1)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pred_<target> columns, without any shuffle; works on streams. Tasks gather rows, so that trees are seldom read."""
        plain, names = self, [f"p{i}" for i in range(len(self.targets))]

        @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for cols in parts:
                cols = cols if isinstance(cols, tuple) else (cols,)         # Spark gives a single column as it is
                held.append(np.column_stack([c.to_numpy(np.int32) for c in cols]))
                n += len(held[-1])
                if n >= PASS:
                    yield pd.DataFrame(plain.predict(np.concatenate(held)), columns=names)
                    held, n = [], 0
            if n:
                yield pd.DataFrame(plain.predict(np.concatenate(held)), columns=names)

        rows = df.withColumn("__pred", score(*[F.col(quoted(b)) for b in self.bins]))
        return rows.withColumns({f"pred_{m}": F.col(f"__pred.{n}") for m, n in zip(self.targets, names)}).drop("__pred")

    def importances(self) -> list[float]:
        """Share of the error that each feature's cuts take away: per tree, then the mean over trees, scaled to sum 1."""
        total = np.zeros(len(self.bins))
        for own in map(np.array, self.gains):
            total += own / own.sum() if own.sum() > 0 else 0.0
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def first(self, trees: int) -> StoredForest:
        """The forest that as many trees would have grown into: a tree's draws and cuts do not depend on the trees after it."""
        kept = [i for i, t in enumerate(self.trees) if t < trees]
        if len(kept) == len(self.trees):
            return self
        return replace(self, trees=[self.trees[i] for i in kept], gains=[self.gains[i] for i in kept])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.read.schema(SUBTREES_SCHEMA).parquet(self.path).filter(F.col("tree").isin(self.trees)).write.mode("overwrite").partitionBy("tree").parquet(f"{path}/trees")
        head = {"bins": self.bins, "targets": self.targets, "trees": self.trees, "gains": self.gains, "upper": self.tops.to_lists()}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredForest:
        """The trees are copied to the shared folder, since tasks can't open every path that Spark can."""
        head = json.loads(spark.read.text(f"{path}/forest").first()["value"])
        own = shared_dir(spark, "forest")
        spark.read.schema(SUBTREES_SCHEMA).parquet(f"{path}/trees").write.partitionBy("tree").parquet(own)
        return StoredForest(head["bins"], head["targets"], own, head["trees"], _Tops.from_lists(head["upper"]), head["gains"])


def _subtrees(path: str, tree: int) -> Iterator[tuple]:
    """(top, feature, cut, low, leaf) of one stored tree."""
    files, at = pfs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (pfs.LocalFileSystem(), path)
    for f in sorted(files.get_file_info(pfs.FileSelector(f"{at}/tree={tree}")), key=lambda i: i.path):
        if f.path.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                for b in pq.ParquetFile(source).iter_batches(1, columns=["top", "feature", "cut", "low", "leaf"]):
                    yield b.column(0)[0].as_py(), *(b.column(i).flatten().to_numpy() for i in range(1, 5))


def _leaf(feature: np.ndarray, cut: np.ndarray, low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place in the leaves of each bin vector."""
    at, live = np.zeros(len(rows), np.int32), np.arange(len(rows))
    while len(live):
        f = feature[at[live]]
        live, f = live[f >= 0], f[f >= 0]
        here = at[live]
        at[live] = low[here] + (rows[live, f] > cut[here])
    return low[at]


class _Tops:
    """The upper part of every tree: cuts found from aggregates so far. Nodes are numbered in the order they appear."""

    def __init__(self, trees: int):
        self.cuts: list[dict[int, tuple[int, int, int, float]]] = [{} for _ in range(trees)]      # node -> feature, cut, low child, gain
        self.depth: list[dict[int, int]] = [{0: 0} for _ in range(trees)]

    def split(self, tree: int, node: int, feature: int, cut: int, gain: float) -> None:
        child = len(self.depth[tree])
        self.cuts[tree][node] = (feature, cut, child, gain)
        for k in (0, 1):
            self.depth[tree][child + k] = self.depth[tree][node] + 1

    def to_lists(self) -> list[list[list]]:
        """Per tree the cuts in the order they were made."""
        return [[[node, *cut] for node, cut in cuts.items()] for cuts in self.cuts]

    @staticmethod
    def from_lists(upper: list[list[list]]) -> _Tops:
        out = _Tops(len(upper))
        for tree, cuts in enumerate(upper):
            for node, feature, cut, _, gain in cuts:
                out.split(tree, node, feature, cut, gain)
        return out

    def place(self, tree: int, rows: np.ndarray) -> np.ndarray:
        """The lowest known node of each row."""
        node = np.zeros(len(rows), np.int64)
        for at in sorted(self.cuts[tree]):           # parents come before their children
            f, cut, child, _ = self.cuts[tree][at]
            here = node == at
            node[here] = child + (rows[here, f] > cut)
        return node


def _arrays(pdf: pd.DataFrame, bins: Sequence[str], targets: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    drawn = np.concatenate(pdf["__draws"].to_numpy()).astype(np.int64).reshape(len(pdf), -1) if len(pdf) else np.zeros((0, 0), np.int64)
    return pdf[list(bins)].to_numpy(np.int64), pdf[list(targets)].to_numpy(float), drawn


def _packed(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """The drawn vectors of a batch, one row of packed arrays per node: each tree draws most vectors, so rows of single vectors
    would be shuffled and sorted once per tree."""
    on = np.flatnonzero(drawn)
    nodes = np.unique(place[on])
    own = [on[place[on] == top] for top in nodes]
    return pd.DataFrame({"top": nodes.astype(np.int32), **{c: [v[i].tobytes() for i in own] for c, v in (("x", x), ("y", y), ("w", drawn))}})


def fit_forest(vectors: DataFrame, bins: Sequence[str], targets: Sequence[str], trees: int, depth: int, n_bins: int, seed: int = 42,
               local: int = LOCAL) -> StoredForest:
    """vectors: distinct bin vectors with __w (their number of rows) and the targets' means."""
    bins, targets, spark = list(bins), list(targets), vectors.sparkSession
    # Vectors are few bytes but much work, so every core gets some.
    dealt_out = vectors.select(*bins, "__w", *targets).repartition(4 * spark.sparkContext.defaultParallelism, *bins)
    data = materialize(with_draws(dealt_out, bins, trees, seed))
    tops, m = _Tops(trees), len(targets)
    # Levels by aggregates, for nodes that no single task should grow. A level also tells the sizes of the next one's nodes.
    wide = {(tree, 0) for tree, n in _sizes(data, bins, targets).items() if n > local and depth > 0}
    while wide:
        found, wide = _level(data, bins, targets, tops, wide, n_bins), set()
        for tree, node, feature, cut, gain, low, high in found:
            tops.split(tree, node, feature, cut, gain)
            child = tops.cuts[tree][node][2]
            wide |= {(tree, child + k) for k, n in enumerate((low, high)) if n > local and tops.depth[tree][child] < depth}

    kind = np.min_scalar_type(max(n_bins, 1))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x, y, drawn = _arrays(p, bins, targets)
            for tree in range(trees):
                if drawn[:, tree].any():
                    yield _packed(x.astype(kind), y, drawn[:, tree], tops.place(tree, x)).assign(tree=np.int32(tree))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        tree, top = int(rows["tree"].iloc[0]), int(rows["top"].iloc[0])
        x, y, w = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("x", kind), ("y", np.float64), ("w", np.int64)))
        x, y = x.reshape(-1, len(bins)).astype(np.int64), y.reshape(-1, m)
        order = np.lexsort(x.T[::-1])                # sums do not depend on the order vectors arrive in
        got = grow(x[order], w[order].astype(float), y[order], depth - tops.depth[tree][top], n_bins)
        inner = got["feature"] >= 0
        one = {"feature": got["feature"], "cut": got["cut"], "low": np.where(inner, got["low"], np.cumsum(~inner) - 1), "leaf": got["value"][~inner].reshape(-1),
               "gains": np.bincount(got["feature"][inner], got["gain"][inner], len(bins))}
        return pd.DataFrame({"tree": [tree], "top": [top], **{k: [v] for k, v in one.items()}})

    dealt = data.mapInPandas(deal, "top int, x binary, y binary, w binary, tree int")
    path = shared_dir(spark, "forest")
    dealt.groupBy("tree", "top").applyInPandas(finish, SUBTREES_SCHEMA).write.partitionBy("tree").parquet(path)
    stored = spark.read.schema(SUBTREES_SCHEMA).parquet(path)
    # One row per subtree, a few numbers each.
    found = sorted(stored.select("tree", "top", "gains").collect(), key=lambda r: (r["tree"], r["top"]))
    if not found:
        means = vectors.agg(*[F.expr(f"coalesce(sum(__w * {quoted(t)}) / sum(__w), 0D)").alias(f"y{i}") for i, t in enumerate(targets)]).first()
        leaf = [(0, 0, [-1], [0], [0], [float(v) for v in means], [0.0] * len(bins))]
        spark.createDataFrame(leaf, SUBTREES_SCHEMA).write.mode("append").partitionBy("tree").parquet(path)
        return StoredForest(bins, targets, path, [0], _Tops(trees), [[0.0] * len(bins)], trees)
    gains: dict[int, np.ndarray] = {}               # a tree that drew no row at all is left out
    for r in found:
        own = gains.setdefault(r["tree"], np.zeros(len(bins)))
        own += r["gains"]
    for tree, own in gains.items():
        for f, _, _, g in tops.cuts[tree].values():
            own[f] += g
    return StoredForest(bins, targets, path, list(gains), tops, [own.tolist() for own in gains.values()], trees)


def _sizes(data: DataFrame, bins: list[str], targets: list[str]) -> dict[int, int]:
    """Drawn vectors per tree."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            drawn = _arrays(p, bins, targets)[2]
            yield pd.DataFrame({"tree": np.arange(drawn.shape[1]), "n": (drawn > 0).sum(axis=0)})

    rows = data.mapInPandas(count, "tree int, n bigint").groupBy("tree").agg(F.sum("n").alias("n")).collect()
    return {r["tree"]: r["n"] for r in rows}


def _level(data: DataFrame, bins: list[str], targets: list[str], tops: _Tops, wide: set[tuple[int, int]], n_bins: int) -> list[tuple]:
    """Best cuts of the wide nodes from one aggregate: (tree, node, feature, cut, gain, vectors below, vectors above).

    A node whose targets are all the same is left out.
    """
    m = len(targets)
    names = ["w", *[f"s{i}" for i in range(m)], "n"]
    ends = [f"y{i}{e}" for i in range(m) for e in "lh"]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x, y, drawn = _arrays(p, bins, targets)
            for tree in sorted({t for t, _ in wide}):
                nodes = sorted(n for t, n in wide if t == tree)
                at = tops.place(tree, x)
                for node in nodes:
                    on = (at == node) & (drawn[:, tree] > 0)
                    if on.any():
                        own = x[on]
                        cells = count_cells(own, drawn[on, tree].astype(float), y[on], np.zeros(len(own), np.int64), 1, n_bins)[0]
                        f, b = np.nonzero(cells[..., 0])
                        vectors = np.stack([np.bincount(own[:, k], minlength=n_bins) for k in range(len(bins))])
                        out = pd.DataFrame(cells[f, b], columns=names[:-1]).assign(tree=tree, node=node, f=f, b=b, n=vectors[f, b])
                        yield out.assign(**{f"y{i}{e}": v for e, ys in (("l", y[on].min(axis=0)), ("h", y[on].max(axis=0))) for i, v in enumerate(ys)})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cells, vectors = np.zeros((1, len(bins), n_bins, 1 + m)), np.zeros((len(bins), n_bins), np.int64)
        cells[0, rows["f"], rows["b"]] = rows[names[:-1]].to_numpy(float)
        vectors[rows["f"], rows["b"]] = rows["n"]
        lo, hi = (rows[[f"y{i}{e}" for i in range(m)]].to_numpy(float) for e in "lh")
        lo, hi = lo.min(axis=0), hi.max(axis=0)
        flat = bool((hi - lo <= 1e-12 * np.maximum(1.0, np.abs(hi))).all())
        feature, cut, gain = best_cuts(cells, np.array([not flat]))
        below = int(vectors[feature[0], :cut[0] + 1].sum())
        return pd.DataFrame({"tree": rows["tree"].iloc[:1].to_numpy(), "node": rows["node"].iloc[:1].to_numpy(), "feature": feature, "cut": cut, "gain": gain,
                             "below": below, "above": int(vectors[feature[0]].sum()) - below})

    sent = data.mapInPandas(count, ", ".join([*[f"{n} double" for n in names[:-1]], "tree int, node int, f int, b int, n bigint", *[f"{e} double" for e in ends]]))
    sums = sent.groupBy("tree", "node", "f", "b").agg(*[F.sum(n).alias(n) for n in names], *[(F.min if e[-1] == "l" else F.max)(e).alias(e) for e in ends])
    found = sums.groupBy("tree", "node").applyInPandas(choose, "tree int, node int, feature int, cut int, gain double, below bigint, above bigint")
    return sorted(tuple(r) for r in found.filter("feature >= 0").collect())
