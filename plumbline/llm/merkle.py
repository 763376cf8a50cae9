"""Merkle manifest of a data set: one hash tree per language, their roots joined by one more tree, and checked proofs.

Leaves are numbered by id inside their language and cut into aligned blocks of 2^HEIGHT. A task builds one block: its
nodes lie in van Emde Boas order, that is the top half of the tree's levels first, then every subtree below it, each laid
out the same way. `address` finds a node's place from its depth and index alone, at any height, and serves both the
construction and the retrieval of siblings. The block roots are the leaves of the next tier, and so on until one block is
left; the roots of the languages are treated likewise. Proofs run downwards: a tier's siblings are read from its stored
blocks and put before the path of the block's own root.

An inner node is the hash of its children's hex digests; the last one of a run may have a single child.

Defined cases: null fields are `-`; a null id sorts first, and is never tampered with; rows with the same id are ordered
by their leaf; repeated rows are leaves of their own; a null language is a tree of its own, the first one; a lone leaf is
its language's root, a lone language's root the root of all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import same_keys
from ..functions.positions import numbered
from .common import written

HEIGHT = 12            # levels below a block's root: at most 4,096 leaves, 256 KB of digests
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
STEP = 33              # bytes of a path step: which side the sibling is on (0: there is none), and its digest
NONE, LEFT, RIGHT = 0, 1, 2


def address(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes `index` at `depth` of a full tree with `height` levels below its root."""
    at, index, levels = np.zeros(len(index), np.int64), np.asarray(index, np.int64), height + 1
    while levels > 1:
        top = levels // 2
        bottom = levels - top
        if depth < top:
            levels = top
            continue
        below = depth - top
        at += (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1)
        depth, index, levels = below, index & ((1 << below) - 1), bottom
    return at


@functools.cache
def _level(depth: int, height: int) -> np.ndarray:
    return address(depth, np.arange(1 << depth), height)


def parent(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def widths(count: int, height: int) -> list[int]:
    """Nodes per level of a block, leaves first."""
    return [-(-count // (1 << up)) for up in range(height + 1)]


def build(leaves: list[bytes], height: int) -> bytes:
    """All nodes of a block, 32 bytes each, in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[_level(depth, height)[:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [parent(*row[i:i + 2]) for i in range(0, len(row), 2)]
    return nodes.tobytes()


def siblings(nodes: bytes, slots: np.ndarray, count: int, height: int) -> list[bytes]:
    """Steps from each leaf to the block's root, joined."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    steps = np.zeros((len(slots), height, STEP), np.uint8)
    for up, width in enumerate(widths(count, height)[:height]):
        other = (slots >> up) ^ 1
        there = other < width
        steps[there, up, 0] = np.where(other[there] & 1, RIGHT, LEFT)
        steps[there, up, 1:] = stored[address(height - up, other[there], height)]
    return [s.tobytes() for s in steps]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its path."""
    for at in range(0, len(path), STEP):
        side, other = path[at], path[at + 1:at + STEP]
        leaf = parent(leaf) if side == NONE else parent(other, leaf) if side == LEFT else parent(leaf, other)
    return leaf


def proof_digest(path: bytes) -> str:
    return sha256("".join(path[at + 1:at + STEP].hex() for at in range(0, len(path), STEP) if path[at] != NONE).encode()).hexdigest()


def _height(n: Column, height: int) -> Column:
    """Levels below the root of a block in a tree of n leaves: a lone block stops where one node is left."""
    return F.when(n > (1 << height), height).otherwise(F.ceil(F.log2(n.cast("double")))).cast("int")


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks of a tier. nodes: tree, position, digest, n (nodes of the tree in this tier). Result: tree, block, n, count,
    height, stored, root."""
    mask = (1 << height) - 1

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        tall = int(rows["height"].iloc[0])
        stored = build([bytes(d) for d in rows["digest"]], tall)
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "n": rows["n"].iloc[:1], "count": [len(rows)],
                             "height": [tall], "stored": [stored], "root": [stored[:32]]})

    cut = nodes.select("tree", F.shiftright("position", height).alias("block"), F.col("position").bitwiseAND(F.lit(mask)).alias("slot"),
                       "digest", "n", _height(F.col("n"), height).alias("height"))
    return written(cut.groupBy("tree", "block").applyInPandas(
        make, "tree bigint, block bigint, n bigint, count int, height int, stored binary, root binary"), "blocks")


def forest(nodes: DataFrame, most: int, height: int = HEIGHT) -> list[DataFrame]:
    """Tiers of blocks over the leaves (tree, position, digest, n) of trees with at most `most` leaves."""
    tiers = [_tier(nodes, height)]
    while most > 1 << height:
        most = -(-most // (1 << height))
        above = tiers[-1].filter(F.col("n") > (1 << height)).select(
            "tree", F.col("block").alias("position"), F.col("root").alias("digest"),
            F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"))
        tiers.append(_tier(above, height))
    return tiers


def roots(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, root."""
    done = [t.filter(F.col("n") <= (1 << height)).select("tree", "root") for t in tiers]
    return functools.reduce(DataFrame.unionByName, done)


def _paths(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """tree, position, path of inner rows (tree, block, slot, position), whose blocks carry the path of their root."""

    def find(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b, slots = block.iloc[0], some["slot"].to_numpy(np.int64)
        found = siblings(b["stored"], slots, int(b["count"]), int(b["height"]))
        return pd.DataFrame({"tree": some["tree"], "position": some["position"], "path": [p + bytes(b["path"]) for p in found]})

    return written(rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        find, "tree bigint, position bigint, path binary"), "paths")


def with_paths(tiers: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest tier's blocks with the path from their root to the very top. above: tree, path of each tree's root."""
    paths = None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        last = tier.filter(F.col("n") <= (1 << height)).join(above, "tree")
        if paths is not None:
            more = tier.filter(F.col("n") > (1 << height)).join(paths.withColumnRenamed("position", "block"), ["tree", "block"])
            last = last.unionByName(more, allowMissingColumns=True)
        if k == 0:
            return last
        below = tiers[k - 1].filter(F.col("n") > (1 << height)).select("tree", F.col("block").alias("position"))
        rows = below.select("tree", "position", F.shiftright("position", height).alias("block"),
                            F.col("position").bitwiseAND(F.lit((1 << height) - 1)).alias("slot"))
        paths = _paths(rows, last)
    raise ValueError("no tiers")


def _field(name: str, value: Column | None = None) -> Column:
    c = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed (the leaf after tampering, null where nothing changes)."""
    hashed = lambda **new: F.unhex(F.sha2(F.concat(*[_field(c, new.get(c)) for c in FIELDS]).cast("binary"), 256))
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), hashed().alias("leaf"),
                       F.when(hit, hashed(n_chars=F.col("n_chars") + 1)).alias("changed"))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row of `docs`."""
    spark = docs.sparkSession
    result = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    rows = written(leaves(docs), "leaves")
    per_lang = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    most = per_lang.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("n")).first()
    if not most["trees"]:
        return spark.createDataFrame([], result)
    trees = written(numbered(per_lang, [], [F.col("lang").asc_nulls_first()], "tree"), "trees")
    ordered = numbered(rows, ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    ordered = written(same_keys(ordered, trees, ["lang"]).drop("lang"), "ordered")

    tiers = forest(ordered.select("tree", "position", F.col("leaf").alias("digest"), "n"), most["n"], height)
    subroots = written(roots(tiers, height), "subroots")
    top = forest(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"), F.col("root").alias("digest"),
                                 F.lit(most["trees"]).cast("bigint").alias("n")), most["trees"], height)
    root = bytes(roots(top, height).first()["root"])

    start = spark.createDataFrame([(0, b"")], "tree bigint, path binary")
    top_blocks = with_paths(top, start, height)
    mask = F.lit((1 << height) - 1)
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"),
                           F.shiftright("tree", height).alias("block"), F.col("tree").bitwiseAND(mask).alias("slot"))
    above = _paths(tops, top_blocks).select(F.col("position").alias("tree"), "path")
    blocks = with_paths(tiers, above, height).drop("root").join(subroots.withColumnRenamed("root", "subroot"), "tree")
    docs_in = ordered.select("tree", F.shiftright("position", height).alias("block"), F.col("position").bitwiseAND(mask).alias("slot"),
                             F.col("doc_id").cast("string").alias("doc_id"), "leaf", "changed")    # pandas has no long with nulls

    def prove(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        found = siblings(b["stored"], some["slot"].to_numpy(np.int64), int(b["count"]), int(b["height"]))
        out = []
        for doc_id, leaf, changed, path in zip(some["doc_id"], some["leaf"], some["changed"], found):
            path += bytes(b["path"])
            folded = fold(bytes(leaf if changed is None else changed), path)
            out.append((doc_id, bytes(leaf).hex(), bytes(b["subroot"]).hex(), root.hex(), proof_digest(path), folded.hex(), folded == root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    proven = docs_in.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        prove, result.replace("doc_id bigint", "doc_id string"))
    return proven.withColumn("doc_id", F.col("doc_id").cast("bigint"))

