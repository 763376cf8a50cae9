"""SimHash near-duplicates: fingerprints, and the binary trie self-join that links them.

Two fingerprints within `budget` = 3 bits agree wholly on one of four 16-bit blocks. So every distinct fingerprint goes
to four groups, one per block; inside a group the other 48 bits form a binary trie, whose node pairs are walked together
while differing bits are added up, and a pair is dropped once they exceed the budget. Groups above `limit` fingerprints
are split by the next bits of the trie: each fingerprint visits the subtrees whose prefix is within the budget of its
own, so every pair still meets exactly where it can match. A task returns a spanning forest of its links, never all
pairs; the forests are joined by contracting edges until none is left.

Defined cases: null or empty text (and text of spaces) has fingerprint zero, linked like any other; equal texts have
equal fingerprints and one component; rows with the same id and text are returned each; a component whose ids are all
null has component null, and `keep_one` prefers the smallest id that is not null; an empty table gives an empty result;
other columns are ignored by `components` and returned untouched by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, written

SEED, WINDOW, BUDGET = 42, 3, 3
LIMIT = 20_000          # distinct fingerprints of a group that one task walks through unsplit
PAIRS = 1 << 14         # node pairs per step of the walk
HASHES = 1 << 15        # shingle hashes per step of the bit count


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half the XXH64 hashes of the 3-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WINDOW + 1)
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        grams = zip(words[at:min(n, at + HASHES)], words[at + 1:], words[at + 2:]) if n > 1 or len(words) == WINDOW else [words]
        h = np.array([hashed(b" ".join(g), SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _print(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


class Forest:
    """Disjoint sets over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place in keys[lo:hi] (sorted, equal above `bit`) that has the bit set."""
    one = np.uint64(1)
    target = (keys[lo] >> bit | one) << bit
    return np.clip(np.searchsorted(keys, target), lo, hi)


def walk(left: np.ndarray, right: np.ndarray, starts: tuple[np.ndarray, ...], same: bool, forest: Forest,
         shift: int, budget: int = BUDGET) -> None:
    """Walk the tries of two sorted key arrays together and unite what is within the budget.

    starts: (lo, hi) ranges in `left` and (lo, hi) ranges in `right` that begin as node pairs, 48 bits deep each.
    `right` is counted from `shift` in the forest.
    """
    stack = []

    def push(depth, *cols):
        for i in range(0, len(cols[0]), PAIRS):
            stack.append((depth, *[c[i:i + PAIRS] for c in cols]))

    push(0, *starts, np.zeros(len(starts[0]), np.int64))
    size, since, roots, breaks = len(forest.parent), 0, None, None
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if roots is not None:  # two subtrees that are one component already need no walk
            flat = (breaks[alo] == breaks[ahi - 1]) & (breaks[blo + shift] == breaks[bhi + shift - 1]) & (roots[alo] == roots[blo + shift])
            alo, ahi, blo, bhi, diff = (x[~flat] for x in (alo, ahi, blo, bhi, diff))
        area = (ahi - alo) * (bhi - blo)
        leaf = (area <= 36) | (depth == 48)
        if leaf.any():
            at, many = np.flatnonzero(leaf), area[leaf]
            pair = np.repeat(at, many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = (bhi - blo)[pair]
            i, j = alo[pair] + k // wide, blo[pair] + k % wide
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            forest.union(i[near], j[near] + shift)
            since += len(i)
            if since > 4 * size:
                since, roots = 0, forest.roots()
                breaks = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
        go = ~leaf
        if not go.any():
            continue
        alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        bit = np.uint64(47 - depth)
        am, bm = _split(left, alo, ahi, bit), _split(right, blo, bhi, bit)
        own = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        out = []
        for x0, x1, y0, y1, more, use in ((alo, am, blo, bm, 0, True), (am, ahi, bm, bhi, 0, True),
                                          (alo, am, bm, bhi, 1, True), (am, ahi, blo, bm, 1, ~own)):
            ok = (x1 > x0) & (y1 > y0) & (diff + more <= budget) & use
            out.append([c[ok] for c in (x0, x1, y0, y1, diff + more)])
        push(depth + 1, *[np.concatenate(c) for c in zip(*out)])


def _ranges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(ids)).astype(np.int64)[:len(cut)]


def _rotated(fp: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The fingerprint with its agreed block moved to the top."""
    turn = (np.uint64(16) * (np.uint64(3) - block.astype(np.uint64))) % np.uint64(64)
    back = (np.uint64(64) - turn) % np.uint64(64)
    return np.where(turn == 0, fp, fp << turn | fp >> back)


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forest (a, b) of the links among the groups of one partition."""
    rows = pd.concat(list(parts) or [pd.DataFrame({c: [] for c in ("block", "depth", "key", "sub", "home", "fp")})])
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if rows.empty:
        yield none
        return
    for block, group in rows[rows["depth"] == 0].groupby("block"):
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        keys = _rotated(fp, np.full(len(fp), block))
        order = np.argsort(keys)
        keys, fp = keys[order], fp[order]
        lo, hi = _ranges(keys >> np.uint64(48))
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        yield from _edges(fp, keys, keys, (lo, hi, lo, hi), True, 0)
    for (block, _, _), group in rows[rows["depth"] > 0].groupby(["block", "key", "sub"]):
        sides = []
        for home in (True, False):
            fp = group.loc[group["home"] == home, "fp"].to_numpy(np.int64).view(np.uint64)
            keys = _rotated(fp, np.full(len(fp), block))
            order = np.argsort(keys)
            sides.append((keys[order], fp[order]))
        (keys, fp), (others, guests) = sides
        if not len(fp):
            continue
        n, m = np.array([len(fp)]), np.array([len(guests)])
        zero, forest = np.zeros(1, np.int64), Forest(len(fp) + len(guests))
        walk(keys, keys, (zero, n, zero, n), True, forest, 0)
        if len(guests):
            walk(keys, others, (zero, n, zero, m), False, forest, len(fp))
        yield _star(np.concatenate([fp, guests]), forest)


def _edges(fp, left, right, starts, same, shift) -> Iterator[pd.DataFrame]:
    forest = Forest(len(fp))
    walk(left, right, starts, same, forest, shift)
    yield _star(fp, forest)


def _star(fp: np.ndarray, forest: Forest) -> pd.DataFrame:
    roots = forest.roots()
    child = np.flatnonzero(roots != np.arange(len(roots)))
    return pd.DataFrame({"a": fp[child].view(np.int64), "b": fp[roots[child]].view(np.int64)})


def links(prints: DataFrame, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) that keep every connection within the budget."""
    block = "shiftrightunsigned(fp, 16 * block) & 65535"
    rows = prints.select("fp", F.explode(F.array(*map(F.lit, range(4)))).alias("block")).withColumn("key", F.expr(block))
    # At most 4 x 65,536 groups exist at any size, so their depths fit into a broadcast.
    big = rows.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    depth = big.select(F.col("block").alias("b_block"), F.col("key").alias("b_key"),
                       F.least(F.lit(16), F.ceil(F.log2(F.col("n") / limit))).cast("int").alias("depth"))
    rows = rows.join(F.broadcast(depth), (F.col("block") == F.col("b_block")) & (F.col("key") == F.col("b_key")), "left").select(
        "fp", "block", "key", F.coalesce("depth", F.lit(0)).alias("depth"))
    top = ("shiftrightunsigned(shiftleft(fp, (16 * (4 - block)) % 64) | "
           "if(block = 0, 0L, shiftrightunsigned(fp, 16 * block)), 64 - depth)")
    rows = rows.withColumn("own", F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.expr(top)))
    flips = {d: [0] + [sum(1 << i for i in c) for k in range(1, budget + 1) for c in combinations(range(d), k)] for d in range(1, 17)}
    visit = F.when(F.col("depth") == 0, F.array(F.lit(0).cast("bigint")))
    for d, masks in flips.items():
        near = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
        visit = visit.when(F.col("depth") == d, F.filter(F.transform(near, lambda m: F.col("own").bitwiseXOR(m)), lambda q: q <= F.col("own")))
    sent = rows.select("block", "depth", "key", "own", "fp", F.explode(visit).alias("sub"))
    sent = sent.select("block", "depth", "key", "sub", (F.col("sub") == F.col("own")).alias("home"), "fp")
    return sent.repartition("block", "key", "sub").mapInPandas(_forest, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """node, root of every node of an edge list (a, b): edges are contracted round by round, at least halving the nodes."""
    edges, maps = written(edges.filter("a != b").distinct(), "edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        for _ in range(2):
            above = up.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            up = up.join(above, F.col("root") == F.col("mid")).select("node", F.col("top").alias("root"))
        up = written(up, "roots")
        maps.append(up)
        a, b = (up.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = edges.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb"))
        edges = written(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a != b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for nxt in maps[1:]:
        above = nxt.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        out = out.join(above, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def _classes(prints: DataFrame, order: str, limit: int) -> DataFrame:
    """fp, first: for every distinct fingerprint the smallest `order` value of its component."""
    nodes = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "prints")
    roots = connected(links(nodes.select("fp"), limit)).withColumnRenamed("node", "fp")
    linked = written(nodes.join(roots, "fp"), "linked")
    firsts = linked.groupBy("root").agg(F.min("first").alias("all_first"))
    linked = linked.join(firsts, "root").select(F.col("fp").alias("l_fp"), "all_first")
    return nodes.join(linked, F.col("fp") == F.col("l_fp"), "left").select("fp", F.coalesce("all_first", "first").alias("first"))


def components(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id; one row per row of `docs`."""
    rows = texts(docs)
    prints = written(rows.select("doc_id", _print("text").alias("fp")), "simhash")
    found = _classes(prints, "doc_id", limit).select(F.col("fp").alias("c_fp"), F.col("first").alias("component_id"))
    return prints.join(found, F.col("fp") == F.col("c_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of `docs`, one of each component (that with the smallest id), with their columns as they were."""
    key = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit("second")).alias("k2")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").select("row", "doc_id", "text", *key)
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "k1", "k2").alias("rank")
    prints = written(rows.select(rank, _print("text").alias("fp")), "simhash")
    firsts = _classes(prints, "rank", limit).select("first.k1", "first.k2").distinct()
    kept = rows.join(firsts, ["k1", "k2"]).withColumn("copy", F.expr("row_number() over (partition by k1, k2 order by k1)"))
    return kept.filter("copy = 1").select("row.*")
