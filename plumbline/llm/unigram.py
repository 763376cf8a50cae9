"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces, their scores and types come from a SentencePiece model file, whose path is a parameter. A text gets the
whitespace marker for its spaces and in front, and the path of pieces with the highest sum of scores; characters that no
piece covers become byte pieces. No piece spans the start of a word (a marker after another character), so words are
encoded one by one: all new words of a batch together, the trie being walked for all of them at once.

Defined cases: null or empty text has no ids and decodes to the empty text; a text that holds the marker itself decodes
to a space there; of two paths with equal sums the one with the longer last piece wins; ids of unknown or control
pieces decode to nothing; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHED = 300_000         # words whose ids a task remembers
LONG = 64                # bytes above which a word is encoded alone
_WORD = re.compile(" +[^ ]*|[^ ]+")


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, buf[at:at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file, in the order of their ids."""
    out = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                out.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class DoubleArray:
    """Trie over bytes: the child of node s by byte c is t = base[s] + c + 1 if check[t] = s; value[t] is a piece or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in keys:
            node = 0
            for c in key:
                nxt = tree[node].get(c)
                if nxt is None:
                    nxt = tree[node][c] = len(tree)
                    tree.append({})
                node = nxt
            ends[node] = value
        size = 2 * len(tree) + 1024
        used, shift = bytearray(size), [0] * len(tree)
        used[0], low = 1, 1
        place = [0] * len(tree)
        # Nodes with many children first; the search starts further on once places near its start are hard to find.
        for node in sorted(range(len(tree)), key=lambda i: -len(tree[i])):
            codes = [c + 1 for c in tree[node]]
            if not codes:
                break
            b, tries = max(0, low - min(codes)), 0
            while any(used[b + c] for c in codes):
                b, tries = b + 1, tries + 1
                if b + 514 > size:
                    used += bytes(size)
                    size *= 2
            if tries > 64:
                low = b + min(codes)
            while used[low]:
                low += 1
            shift[node] = b
            for c, kid in tree[node].items():
                used[b + c + 1], place[kid] = 1, b + c + 1
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for node, kids in enumerate(tree):
            base[place[node]] = shift[node]
            value[place[node]] = ends.get(node, -1)
            for kid in kids.values():
                check[place[kid]] = place[node]
        self.base, self.check, self.value = base, check, value

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child, or -1."""
        t = self.base[node] + byte + 1
        return np.where((t < len(self.check)) & (self.check[np.minimum(t, len(self.check) - 1)] == node), t, -1)


class Model:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        keys = [(p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER)):
            raise ValueError("a piece spans the start of a word")
        self.trie = DoubleArray(keys)
        self.scores = np.array([s for _, s, _ in pieces])
        self.longest = max(len(k) for k, _ in keys)
        self.unknown = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unk = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.of_byte = np.full(256, self.unk)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.of_byte[int(p[3:5], 16)] = i
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.words: dict[str, bytes] = {}

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """Piece ids of words (little-endian unsigned 32-bit)."""
        n, width = len(words), max(map(len, words))
        text = np.zeros((n, width + 1), np.int32)
        for i, w in enumerate(words):
            text[i, :len(w)] = np.frombuffer(w, np.uint8)
        size = np.array([len(w) for w in words])
        lead = (text & 0xC0) != 0x80                        # first bytes of characters
        best = np.full((n, width + 1), -np.inf)
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        for at in range(width):
            row = np.flatnonzero((at < size) & lead[:, at] & (best[:, at] > -np.inf))
            if not len(row):
                continue
            first = text[row, at]
            wide = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            end = np.minimum(at + wide, size[row])
            self._better(best, back, piece, row, end, at, best[row, at] + self.unknown, np.full(len(row), -1))
            node, live = np.zeros(len(row), np.int32), row
            for k in range(at, min(width, at + self.longest)):
                node = self.trie.step(node, text[live, k])
                ok = (node >= 0) & (k < size[live])
                node, live = node[ok], live[ok]
                if not len(live):
                    break
                v = self.trie.value[node]
                hit = v >= 0
                if hit.any():
                    r, p = live[hit], v[hit]
                    self._better(best, back, piece, r, np.full(len(r), k + 1), at, best[r, at] + self.scores[p], p)
        # The way back of all words at once: (word, start, length, piece) of every step, then in order of their places.
        steps, row, end = [], np.arange(n), size
        while len(row := row[end > 0]):
            end = end[end > 0]
            start = back[row, end]
            steps.append((row, start, end - start, piece[row, end]))
            end = start
        row, start, wide, ids = map(np.concatenate, zip(*steps))
        order = np.lexsort((start, row))
        row, start, wide, ids = row[order], start[order], wide[order], ids[order]
        many = np.where(ids >= 0, 1, wide)
        at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, ids = np.repeat(row, many), np.repeat(ids, many)
        ids = np.where(ids >= 0, ids, self.of_byte[text[row, at]]).astype("<u4")
        raw, cuts = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    @staticmethod
    def _better(best, back, piece, row, end, start, score, value) -> None:
        up = score > best[row, end]
        row, end = row[up], end[up]
        best[row, end], back[row, end], piece[row, end] = score[up], start, value[up]

    def _remember(self, new: set[str]) -> None:
        short: dict[int, list[str]] = {}
        for w in new:
            short.setdefault(min(-(-len(w) // 8), LONG), []).append(w)
        for group in short.values():
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                self.words.update(zip(part, self.viterbi([w.replace(" ", MARK).encode("utf-8", "replace") for w in part])))

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each text."""
        cut = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts_]
        new = set().union(*cut).difference(self.words)
        long = {w for w in new if len(w) > LONG}
        self._remember(new - long)
        for w in long:
            self.words[w] = self._long(w)
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in cut]
        for w in long:
            del self.words[w]
        if len(self.words) > CACHED:
            self.words.clear()
        return out

    def _long(self, word: str) -> bytes:
        """One word of any length: the same recursion with plain numbers and a window of the longest piece."""
        w = word.replace(" ", MARK).encode("utf-8", "replace")
        n = len(w)
        base, check, value = self._lists()
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            c = w[at]
            if (c & 0xC0) == 0x80 or best[at] == -np.inf:
                continue
            end = min(n, at + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4))
            if best[at] + self.unknown > best[end]:
                best[end], back[end], piece[end] = best[at] + self.unknown, at, -1
            node = 0
            for k in range(at, min(n, at + self.longest)):
                t = base[node] + w[k] + 1
                if t >= len(check) or check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0 and best[at] + self.scores[v] > best[k + 1]:
                    best[k + 1], back[k + 1], piece[k + 1] = best[at] + self.scores[v], at, v
        ids, at = [], n
        while at:
            start = back[at]
            ids.append([piece[at]] if piece[at] >= 0 else self.of_byte[list(w[start:at])].tolist())
            at = start
        return np.array([x for part in reversed(ids) for x in part], dtype="<u4").tobytes()

    @functools.cache  # noqa: B019
    def _lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()

    @functools.cached_property
    def _spelled(self) -> list[bytes]:
        return [p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE else b""
                for p, _, kind in self.pieces]

    def decode(self, ids: bytes) -> str:
        """Pieces and bytes joined, markers as spaces, without the space in front."""
        raw = b"".join(map(self._spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Model:
    return Model(read_pieces(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, n_pieces, n_bytes (pieces that stand for a byte), decoded_ok (decoding gives the text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for p in parts:
            for at in range(0, len(p), 1024):
                some = p.iloc[at:at + 1024]
                found = model.encode(some["text"].tolist())
                ids = [np.frombuffer(b, "<i4") for b in found]
                yield pd.DataFrame({
                    "doc_id": some["doc_id"].to_numpy(), "ids": ids, "n_pieces": [len(x) for x in ids],
                    "n_bytes": [int(model.is_byte[x].sum()) for x in ids],
                    "decoded_ok": [model.decode(b) == t.replace(MARK, " ") for b, t in zip(found, some["text"])],
                }).astype({"doc_id": "Int64"})

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInPandas(
        run, "doc_id bigint, ids array<int>, n_pieces bigint, n_bytes bigint, decoded_ok boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table doc_id, ids."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy(), "text": [
                model.decode(np.asarray(x if x is not None else [], dtype="<u4").tobytes()) for x in p["ids"]]}).astype({"doc_id": "Int64"})

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInPandas(run, "doc_id bigint, text string")
