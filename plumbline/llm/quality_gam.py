"""Quality classifier: a generalised additive model with pairwise interactions over plain text statistics.

Every feature has a lookup table over its bins. Cyclic boosting visits the features in turn; each visit fits a shallow
tree to the gradient histogram over the bins and adds a small step of it to the table. Then the pairs with the largest
gain on what is left get tables over two features, boosted in the same way. A score is the sigmoid of table additions.

The model is fitted on at most `SAMPLE` labelled rows (those with the smallest hash of their id), from training rows
only; scoring covers every document and every whole text. Labels, lang, source and id are not features.

Defined cases: null text is empty, an empty text has all features 0 and gets the score of that; equal texts have equal
scores; an id labelled more than once counts as good only if all its labels say so; without labels every score is 1;
an empty table gives an empty result; other columns are ignored by `score` and returned untouched by `keep`.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, one_text, sample_of, texts

SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "distinct", "top_word", "repeats", "upper", "digits", "symbols", "marks", "spaces",
            "short_words", "same_lines", "line_length", "long_words")
_CHUNK = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 upper, 2 digit, 3 symbol, 4 punctuation, 5 space, 6 lower."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = (1 if c.isupper() else 2 if c.isdigit() else 5 if c.isspace() else 6 if c.isalpha() else
                  3 if c in "#*$%&|<>=+~^@\\/_{}[]" else 4)
    out[0x3000:] = 6
    return out


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(7, np.int64)
    for i in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[i:i + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        kinds += np.bincount(_classes()[points], minlength=7)
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    tops = pd.Series(words).value_counts(sort=False).max() if distinct < n else 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    chars, letters = len(text), max(1, kinds[1] + kinds[6])
    return [np.log1p(n), sizes.mean(), distinct / n, tops / n, repeats / n, kinds[1] / letters, kinds[2] / chars,
            kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, (sizes <= 3).mean(), 1 - len(set(lines)) / len(lines),
            np.log1p(chars / len(lines)), (sizes > 20).mean()]


def feature_matrix(texts_: pd.Series) -> np.ndarray:
    return np.array([features(t or "") for t in texts_], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)          # bin edges per feature
    coarse: list[np.ndarray] = field(default_factory=list)         # coarser edges, for pairs
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = np.inf

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for a, b, t in self.pairs:
                z += t[bins[a], bins[b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _best_cut(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins, from sums of gradients and of their weights."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + reg) + gr ** 2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, reg: float) -> np.ndarray:
    """Values of a shallow tree over a histogram of one or two axes."""
    cuts = [(*_best_cut(g.sum(axis=o), h.sum(axis=o), reg), axis) for axis, o in
            enumerate([()] if g.ndim == 1 else [(1,), (0,)])]
    gain, k, axis = max(cuts)
    if not depth or gain <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + reg))
    parts = zip(np.split(g, [k], axis=axis), np.split(h, [k], axis=axis))
    return np.concatenate([_tree(a, b, depth - 1, reg) for a, b in parts], axis=axis)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pair_bins: int = 12,
        n_pairs: int = 6, depth: int = 2, reg: float = 2.0) -> Model:
    if not len(y):
        return Model()
    cuts = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    d, p = x.shape[1], np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Model([cuts(x[:, j], bins) for j in range(d)], [cuts(x[:, j], pair_bins) for j in range(d)], base=float(np.log(p / (1 - p))))
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.base)

    def slopes():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            n = len(m.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), depth, reg)
            m.tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]
    shape = lambda a, b: (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)

    def grid(a, b, w):
        s = shape(a, b)
        return np.bincount(low[a] * s[1] + low[b], w, s[0] * s[1]).reshape(s)

    g, h = slopes()
    gains = []
    for a, b in combinations(range(d), 2):
        gg, hh = grid(a, b, g), grid(a, b, h)
        t = _tree(gg, hh, depth, reg)
        gains.append((float((t * gg - 0.5 * t * t * hh).sum()), a, b))
    for _, a, b in sorted(gains, reverse=True)[:n_pairs]:
        m.pairs.append((a, b, np.zeros(shape(a, b))))
    for _ in range(rounds // 2):
        for a, b, t in m.pairs:
            g, h = slopes()
            step = rate * _tree(grid(a, b, g), grid(a, b, h), depth, reg)
            t += step
            z += step[low[a], low[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled training rows (crc32 of the id modulo 4 is not 2)."""
    truth = (labels.filter("doc_id is not null and quality is not null").filter(~held_out("doc_id", 4, 2))
             .groupBy("doc_id").agg(F.min("quality").alias("y")))
    chosen = sample_of(truth, sample, "doc_id").select(F.col("doc_id").alias("l_id"), "y")
    # At most `sample` pairs of two numbers are broadcast.
    rows = one_text(texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")), "doc_id", "y")
    schema = "doc_id bigint, y int, x array<double>"
    found = rows.mapInPandas(_features_of, schema).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, (found["y"].to_numpy() > 0).astype(np.float64))


def _features_of(parts):
    for p in parts:
        yield pd.DataFrame({"doc_id": p["doc_id"], "y": p["y"], "x": list(feature_matrix(p["text"]))})


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def scored(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_matrix(t)))

    return scored(text)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of `docs`."""
    model = train(docs, labels)
    rows = texts(docs).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score at least the threshold, with their columns as they were."""
    model = train(docs, labels)
    return docs.filter(score_column(model, F.coalesce(F.col("text"), F.lit(""))) >= THRESHOLD)
