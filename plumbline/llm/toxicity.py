"""Toxicity: non-negative positive-unlabelled learning over hashed words and word beginnings.

Only confirmed toxic texts carry a label; the rest of the text is unlabelled and holds some toxic texts too. The risk of
a classifier is estimated as prior * positive risk + max(0, unlabelled risk - prior * positive risk as negatives), and
when the second part turns negative the step goes the other way. Several linear classifiers are trained with numpy, one
per Spark task, on all sampled positives and each on its own share of the unlabelled texts; their margins are averaged.

Bounds: at most `POSITIVES` toxic and `UNLABELLED` other training texts (those with the smallest hash of their id) and
`KEPT` features per classifier. Scoring covers every document and every whole text. Labels, lang, source and id are not
features; held-out rows are neither positives nor unlabelled texts.

Defined cases: null text is empty; an empty text has no features and gets the score of the bias; equal texts have equal
scores; an id counts as toxic if any of its labels says so; without positives every score is 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, one_text, sample_of, texts

POSITIVES, UNLABELLED, BAGS, KEPT = 3_000, 9_000, 3, 4096
BUCKET_BITS = 20
REPEATS = 3            # times that a feature of one text counts at most
START = 0.2           # part of the lift that a weight starts from
MIN_LIFT, MIN_EVIDENCE = 5, 12      # what a feature must show to be used
BEGINNINGS = (4, 5, 6)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@functools.cache
def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[128:] = True
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[c] = True
    return out


def buckets(text: str) -> np.ndarray:
    """Sorted hashed features of a text, each as often as it occurs up to REPEATS: its words, and the first bytes of
    longer words."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    found = []
    for i in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[i:i + _PIECE], np.uint8)
        power, inverse = _powers(max(12, int(len(b)).bit_length()))
        letter = np.concatenate([[False], _letters()[b], [False]])
        turn = np.flatnonzero(letter[1:] != letter[:-1])
        start, end = turn[::2], turn[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.astype(np.uint64) * power[:len(b)], dtype=np.uint64)])
        for k in (0, *BEGINNINGS):
            s = start if not k else start[end - start > k]
            e = end if not k else s + k
            h = (total[e] - total[s]) * inverse[s]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            found.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32)
    out = np.sort(np.concatenate(found))
    return out[np.concatenate([np.ones(min(len(out), REPEATS), bool), out[REPEATS:] != out[:-REPEATS]])]


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def without_copies(rows: list[np.ndarray], likeness: float = 0.6, draws: int = 64) -> list[np.ndarray]:
    """Feature sets without those that mostly repeat an earlier one (by min-hashes), so that copies do not vote."""
    rows = [x for x in rows if len(x)]
    if not rows:
        return rows
    draw = np.random.default_rng(7).integers(1, 1 << 63, draws, dtype=np.uint64) | np.uint64(1)
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])[:-1]])
    all_ = np.concatenate(rows).astype(np.uint64) + np.uint64(1)
    least = np.stack([np.minimum.reduceat((all_ * a) >> np.uint64(32), at) for a in draw], axis=1)
    kept: list[int] = []
    for i in range(len(rows)):
        if not kept or (least[kept] == least[i]).mean(axis=1).max() < likeness:
            kept.append(i)
    return [rows[i] for i in kept]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05,
        decay: float = 1e-4, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias of one classifier trained on the non-negative risk (sigmoid loss)."""
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    size, n_p, n_u = 1 << BUCKET_BITS, max(1, len(positive)), max(1, len(unlabelled))
    count = lambda rows: np.bincount(np.concatenate([*map(_distinct, rows), np.zeros(0, np.int32)]), minlength=size)
    in_p, in_u = count(positive), count(unlabelled)
    lift = np.log((in_p + 0.5) / (n_p + 1)) - np.log((in_u + 0.5) / (n_u + 1))
    share, both = n_p / (n_p + n_u), np.maximum(in_p + in_u, 1)
    # Likelihood-ratio statistic of a feature's split between the two sets.
    evidence = 2 * (in_p * np.log(np.maximum(in_p, 1e-9) / (both * share)) + in_u * np.log(np.maximum(in_u, 1e-9) / (both * (1 - share))))
    ok = np.flatnonzero((in_p >= 3) & (lift > np.log(MIN_LIFT)) & (evidence > MIN_EVIDENCE))
    chosen = np.sort(ok[np.argsort(-evidence[ok], kind="stable")[:kept]])
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def sparse(rows):
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        c = place[np.concatenate([*rows, np.zeros(0, np.int32)])]
        return r[c >= 0], c[c >= 0], len(rows)

    (pr, pc, pn), (ur, uc, un) = sparse(positive), sparse(unlabelled)
    w, bias = START * lift[chosen], -3.0
    state = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    for t in range(1, steps + 1):
        sp = _sigmoid(np.bincount(pr, w[pc], pn) + bias)
        su = _sigmoid(np.bincount(ur, w[uc], un) + bias)
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / n_p, su * (1 - su) / n_u
        if negative >= 0:
            gp, gu = -2 * prior * dp, du
        else:
            gp, gu = prior * dp, -du
        g = np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w)) + decay * w
        g = np.append(g, gp.sum() + gu.sum())
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        move = rate * (state[0] / (1 - 0.9 ** t)) / (np.sqrt(state[1] / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return chosen.astype(np.int32), w, float(bias)


def _featured(parts):
    for p in parts:
        yield pd.DataFrame({"doc_id": p["doc_id"], "bag": p["bag"], "toxic": p["toxic"], "x": [buckets(t or "") for t in p["text"]]})


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          bags: int = BAGS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One classifier per bag; none without a confirmed toxic text."""
    truth = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id", 5, 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    seen = truth.agg(F.avg("toxic").alias("share"), F.sum("toxic").alias("n")).first()
    if not seen["n"]:
        return []
    prior = float(min(0.5, max(0.01, seen["share"])))
    good = sample_of(truth.filter("toxic = 1"), positives, "doc_id").select("doc_id", F.lit(True).alias("toxic"))
    rest = docs.select("doc_id").filter("doc_id is not null").filter(~held_out("doc_id", 5, 0))
    rest = sample_of(rest.join(good.select("doc_id"), "doc_id", "left_anti").distinct(), unlabelled, "doc_id").select("doc_id", F.lit(False).alias("toxic"))
    chosen = good.unionByName(rest).select(F.col("doc_id").alias("c_id"), "toxic")
    # At most positives + unlabelled pairs of an id and a flag are broadcast.
    rows = one_text(texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("c_id")), "doc_id", "toxic")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(bags)).cast("int")
    rows = rows.withColumn("bag", F.explode(F.when(F.col("toxic"), F.sequence(F.lit(0), F.lit(bags - 1))).otherwise(F.array(own))))
    found = rows.mapInPandas(_featured, "doc_id bigint, bag int, toxic boolean, x array<int>")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["toxic", "doc_id"], kind="stable")
        p, u = (list(group.loc[group["toxic"] == k, "x"]) for k in (True, False))
        ids, w, bias = fit(p, u, prior)
        return pd.DataFrame({"bag": [group["bag"].iloc[0]], "ids": [ids], "w": [w], "bias": [bias]})

    models = found.groupBy("bag").applyInPandas(one, "bag int, ids array<int>, w array<double>, bias double").collect()
    return [(np.array(m["ids"], np.int64), np.array(m["w"]), m["bias"]) for m in sorted(models, key=lambda m: m["bag"])]


def score_column(models: list[tuple[np.ndarray, np.ndarray, float]], text: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def scored(t: pd.Series) -> pd.Series:
        table = np.zeros(1 << BUCKET_BITS)
        for ids, w, _ in models:
            table[ids] += w / len(models)
        bias = sum(b for _, _, b in models) / len(models)
        return pd.Series([float(_sigmoid(table[buckets(x or "")].sum() + bias)) for x in t], dtype=float)

    return scored(text) if models else F.lit(0.0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of `docs`."""
    models = train(docs, labels)
    rows = texts(docs).select("doc_id", score_column(models, F.col("text")).alias("score"))
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
