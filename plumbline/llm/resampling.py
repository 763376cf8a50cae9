"""Target-distribution importance resampling with interned n-grams.

Features of a text are all runs of 1 to 3 consecutive words, counted in hashed buckets: over the corpus (raw) and over the
texts of the target. A bucket's gain is the scaled logarithm of the ratio of its two smoothed shares; a document weighs
the sum of its features' gains, gets Gumbel noise drawn from its id, and the highest scores are the sample.

A task interns the n-grams of a batch of texts in an open-addressed NumPy table: the key of an n-gram is the XXH64 of its
bytes, a key's occupant is compared with it word by word (words byte by byte) before they count as one, and others go to
the next slot. A slot stores its n-gram's bucket and count, so the CRC of an n-gram is taken once per batch; occurrences
keep only their slot ids, through which they gather gains. Texts are handled in pieces of CHUNK bytes at any length.

Defined cases: null or empty text has no features and weight 0; documents of under MIN_WORDS words are never drawn; a null
id hashes like an empty one and sorts first; rows equal in score and id are ranked by their feature count, repeated rows
have ranks of their own; an empty table gives an empty result, an empty target gains for a target without words; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.positions import numbered
from .common import written

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
CHUNK = 1 << 20         # bytes of text that are interned together

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_NEXT_WORDS = re.compile(rb"[0-9a-z\x80-\xff]*(?:[^0-9a-z\x80-\xff]+[0-9a-z\x80-\xff]+){0,%d}" % (LONGEST - 1))


# The multipliers of XXH64 and the polynomial of CRC-32 (reflected).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CRC_POLYNOMIAL = 0xEDB88320
SHIFTS = 64             # texts up to this many bytes are appended to a CRC in one step


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of many runs of `data`: those of equal length together, those of 32 bytes and more one by one."""
    padded = data + bytes(8)
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    ones = np.frombuffer(data, np.uint8)
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")
    ends = np.searchsorted(np.minimum(length, 32)[order], np.arange(34))
    for n in range(32):
        some = order[ends[n]:ends[n + 1]]
        if not len(some):
            continue
        at, h = start[some], np.full(len(some), P5 + np.uint64(n))
        for _ in range(n // 8):
            h = _turned(h ^ _turned(eights[at] * P2, 31) * P1, 27) * P1 + P4
            at = at + 8
        if n % 8 >= 4:
            h = _turned(h ^ fours[at].astype(np.uint64) * P1, 23) * P2 + P3
            at = at + 4
        for _ in range(n % 4):
            h = _turned(h ^ ones[at].astype(np.uint64) * P5, 11) * P1
            at = at + 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[some] = h ^ h >> np.uint64(32)
    for i in order[ends[32]:].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + length[i]])
    return out


@functools.cache
def _zero_steps() -> np.ndarray:
    """What each byte of a CRC register becomes after 0 to SHIFTS zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = one >> 1 ^ np.where(one & 1, np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    steps = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    table = [np.stack(steps)]
    for _ in range(SHIFTS):
        table.append(one[table[-1] & 255] ^ table[-1] >> 8)
    return np.stack(table)


def crc_append(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with a tail appended, from the CRCs of both and the tails' lengths in bytes."""
    table, left = _zero_steps(), length.copy()
    while True:
        n = np.minimum(left, SHIFTS)
        crc = table[n, 0, crc & 255] ^ table[n, 1, crc >> 8 & 255] ^ table[n, 2, crc >> 16 & 255] ^ table[n, 3, crc >> 24]
        left = left - n
        if not left.any():
            return crc ^ tail


def intern(keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every key in an open-addressed table, and the table: the occurrence that owns each slot, or -1.

    Occurrences share a slot if their keys are the same and `equal` says so of the two.
    """
    owner = np.full(1 << max(1, int(2 * len(keys)).bit_length()), -1, np.int64)
    mask = np.uint64(len(owner) - 1)
    slot = (keys & mask).astype(np.int64)
    pending = np.arange(len(keys))
    while len(pending):
        at = slot[pending]
        free = owner[at] < 0
        owner[at[free]] = pending[free]
        first = owner[at]
        same = keys[first] == keys[pending]
        other = np.flatnonzero(same & (first != pending))
        same[other] = equal(first[other], pending[other])
        pending = pending[~same]
        slot[pending] = (slot[pending] + 1) & int(mask)
    return slot, owner


def _same_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = length[a] == length[b]
        for at in range(0, len(a), 1 << 16):
            some = np.flatnonzero(same[at:at + (1 << 16)]) + at
            n = length[a[some]]
            if not len(some):
                continue
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            alike = data[np.repeat(start[a[some]], n) + within] == data[np.repeat(start[b[some]], n) + within]
            same[some] = np.logical_and.reduceat(alike, np.cumsum(n) - n)
        return same
    return equal


def pieces(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[list[tuple[int, bytes, int]]]:
    """Batches of (text number, lower-cased bytes, own): features that start in the first `own` bytes are the piece's.

    Pieces begin and end between words; after its own bytes a piece holds the words that its last features reach into.
    """
    batch, held = [], 0
    for i, text in enumerate(texts):
        text, at = text.translate(_LOWER), 0
        while at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and _IN_WORD[text[end]]:
                end += 1
            batch.append((i, text[at:_NEXT_WORDS.match(text, end).end()] if end < len(text) else text[at:], end - at))
            held += end - at
            at = end
            if held >= size:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


class Interned:
    """The features of one batch: per length, the occurrences' texts and slots, and the table's buckets and counts."""

    def __init__(self, batch: list[tuple[int, bytes, int]], buckets: int = BUCKETS):
        data = np.frombuffer(b"\n".join([b for _, b, _ in batch]) + b"\n", np.uint8)
        starts_of = np.cumsum([0] + [len(b) + 1 for _, b, _ in batch])[:-1]
        own_end = starts_of + np.array([own for _, _, own in batch])
        inside = _IN_WORD[data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
        start = np.flatnonzero(edge == 1)
        length = np.flatnonzero(edge == -1) - start
        piece = np.searchsorted(starts_of, start, side="right") - 1
        owned = start < own_end[piece]
        text = np.array([i for i, _, _ in batch])[piece]
        # Words with one space after each: every n-gram is a run of these bytes.
        gapped = np.full(int(length.sum() + len(length)), 32, np.uint8)
        place = np.cumsum(length + 1) - length - 1
        gapped[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[inside]
        joined, self.parts = gapped.tobytes(), []
        at = np.arange(len(start))
        for n in range(1, LONGEST + 1):
            a, size = place[at], length[at + n - 1] + place[at + n - 1] - place[at]
            keys = xxh64(joined, a, size)
            if n == 1:
                slot, owner = intern(keys, _same_bytes(gapped, place, length))
                words = slot
            else:
                slot, owner = intern(keys, lambda i, j: np.logical_and.reduce([words[at[i] + k] == words[at[j] + k] for k in range(n)]))
            used = np.flatnonzero(owner >= 0)
            crc = np.zeros(len(owner), np.uint32)
            if n == 1:
                distinct = [joined[x:x + y] for x, y in zip(a[owner[used]].tolist(), size[owner[used]].tolist())]
                crc[used] = [zlib.crc32(w) for w in distinct]
                tails = np.zeros(len(owner), np.uint32)
                tails[used] = [zlib.crc32(b" " + w) for w in distinct]
            else:
                last = at[owner[used]] + n - 1
                crc[used] = crc_append(head[owner[used]], tails[words[last]], length[last] + 1)
            bucket = (crc % np.uint32(buckets)).astype(np.int64)
            mine = owned[at]
            self.parts.append((text[at[mine]], slot[mine], bucket, np.bincount(slot[mine], minlength=len(owner))))
            # The next longer features: those whose next word is of the same piece, with the CRC of what they begin with.
            on = np.flatnonzero(at + n < len(start))
            on = on[mine[on] & (piece[at[on]] == piece[at[on] + n])]
            at, head = at[on], crc[slot[on]]

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        """Features per bucket."""
        return sum(np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64) for _, _, bucket, count in self.parts)

    def sums(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and summed gains per text."""
        words = np.bincount(self.parts[0][0], minlength=texts)
        features, weight = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for text, slot, bucket, _ in self.parts:
            features += np.bincount(text, minlength=texts)
            np.add.at(weight, text, gains[bucket][slot])
        return words, features, weight


def _bytes_of(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts of a table; a task sends one number per bucket."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for p in parts:
            for batch in pieces(p["text"].to_pylist()):
                n += Interned(batch, buckets).totals(buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    sent = _bytes_of(docs, id_col).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket, in doubles."""
    size = len(raw)
    ratio = (target + 1.0) * (float(raw.sum()) + size) / ((raw + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight; one row per row of `docs`."""
    buckets = len(gain)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            words, features, weight = (np.zeros(len(p), np.int64) for _ in range(3))
            for batch in pieces(p["text"].to_pylist()):
                for whole, part in zip((words, features, weight), Interned(batch, buckets).sums(gain, len(p))):
                    whole += part
            yield pa.RecordBatch.from_arrays([p["doc_id"], pa.array(words), pa.array(features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return _bytes_of(docs, "doc_id").mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of all documents."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, target_id, buckets))
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(drawn, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u))).cast("bigint")
    rows = written(weigh(docs, gain).withColumn("score", F.col("weight") + noise), "weighed")
    wanted = percent * rows.filter(F.col("n_words") >= min_words).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = numbered(rows.withColumn("_fit", F.col("n_words") >= min_words), ["_fit"], order)
    rank = F.when(F.col("_fit") & (F.col("position") < wanted), F.col("position") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
