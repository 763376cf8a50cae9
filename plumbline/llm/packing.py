"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Documents become token pieces; only longer ones are cut, and full pieces are sequences of their own. The other pieces
are sorted by length in parallel, which gives every piece a rank among those as long. Pieces of one length, and gaps of
one size, are interchangeable, so a sweep works on counts (at most `capacity` lengths and gap sizes, at any input size):
in each round the longest waiting pieces go to the gaps of the successor size, the k-th piece of the round to the k-th
gap, and the gaps shrink; pieces that fit nowhere open sequences. The rounds leave a table of runs (length, ranks,
sequences, offset), in which each piece then finds its place by its rank. The result is best-fit decreasing.

Defined cases: null or empty text is one piece that holds the end mark alone; a document of exactly `capacity` tokens is
one full piece; pieces of the same length are ranked by id, place and content, repeated rows get places of their own;
a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import texts, written

CAPACITY, END = 1024, 2
CACHED = 150_000        # words whose ids a task remembers
SLICE = 200_000         # pieces of one length that one ranking group holds on average


@functools.cache
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies print bytes as these characters: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the tokenizer file, with the words of ordinary text encoded once and remembered.

    A space followed by a visible character always starts a new pre-token, so words between single spaces are encoded
    by themselves. New words are encoded together, between line ends, which are pre-tokens of their own before a space.
    Texts with other runs of spaces are encoded as a whole, those with special tokens by the tokenizer itself.
    """

    def __init__(self, path: str):
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.special, self.words = path, sorted(special), {}
        self.line = self.fast.encode_ordinary("\n")[0]

    @functools.cached_property
    def full(self) -> Tokenizer:
        """Made only where a text holds a special token; it takes far more memory than the rest."""
        return Tokenizer.from_file(self.path)

    def _learn(self, new: set[str]) -> bool:
        """Remember words; False if one of them is not set between single spaces."""
        if any(not w or w[0].isspace() or w[-1].isspace() for w in new):
            return False
        plain = [w for w in new if "\n" not in w]
        ids = np.array(self.fast.encode_ordinary(" " + "\n ".join(plain)) if plain else [], dtype="<u4")
        ends = [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
        raw, start = ids.tobytes(), 0
        for w, end in zip(plain, ends):
            self.words[w] = raw[4 * start:4 * end]
            start = end + 1
        for w in new.difference(plain):
            self.words[w] = np.array(self.fast.encode_ordinary(" " + w), dtype="<u4").tobytes()
        return True

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        if len(self.words) > CACHED:
            self.words.clear()
        if not head or head[0].isspace() or head[-1].isspace() or not self._learn(set(rest).difference(self.words)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(head), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): the token pieces of every document."""

    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = _encoder(path), np.array([end], dtype="<u4").tobytes()
        for p in parts:
            for at in range(0, len(p), 256):      # few texts at a time are turned into Python strings
                some, rows = p.slice(at, 256), []
                for i, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    ids = encoder.ids(text or "") + mark
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(i, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def rounds(counts: dict[int, int], capacity: int = CAPACITY, first: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit decreasing over counts of pieces per length.

    In a run, the piece of rank first rank + k goes to sequence first sequence + k. Also the number of sequences.
    """
    runs, gaps, sizes = [], {}, []          # gaps: size -> blocks of sequences (first, count)

    def leave(size: int, start: int, count: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((start, count))

    free = first
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                start, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
                used = min(left, count)
                if used < count:
                    leave(size, start + used, count - used)
            else:
                size, start = capacity, free
                used = -(-left // (capacity // length))
                free += used
            runs.append((length, rank, used, start, capacity - size))
            leave(size - length, start, used)
            rank, left = rank + used, left - used
    return runs, free - first


def ranked(parts: DataFrame, order: list[str], total: int) -> DataFrame:
    """Adds `rank` (from 0) among the pieces of the same length; no task sorts all pieces of a frequent length."""
    slices = max(1, -(-total // SLICE))
    rows = parts.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.expr("sum(n) over (partition by length order by slice) - n"))
    before = before.select(F.col("length").alias("b_length"), F.col("slice").alias("b_slice"), "before")
    here = rows.withColumn("here", F.expr(f"row_number() over (partition by length, slice order by {', '.join(order)}) - 1"))
    both = here.join(before, (F.col("length") == F.col("b_length")) & (F.col("slice") == F.col("b_slice")))
    return both.withColumn("rank", F.col("before") + F.col("here")).drop("b_length", "b_slice", "before", "here", "slice")


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """`parts` (with a column length, 1 to capacity) and sequence_id, offset. `order` names the columns that tell pieces apart."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("pieces have 1 to capacity tokens")
    runs, _ = rounds(counts, capacity)
    # One entry per run: bounded by capacity and the number of rounds, not by the number of pieces.
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy(np.int64) - table[at, 1], "offset": table[at, 4]})

    rows = ranked(parts, order, sum(counts.values())).withColumn("place", place("length", "rank"))
    return rows.select(*parts.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids of each piece if wanted.

    The documents are encoded once; the pieces are kept in the shared folder.
    """
    cut = pieces(docs, path, capacity, end).withColumn("ids_crc32", F.crc32("ids"))
    cut = written(cut if with_ids else cut.drop("ids"), "pieces")
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"], capacity)
