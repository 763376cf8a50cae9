"""Quality in a row's neighbourhood and per block of rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import clean, count_if, numeric_columns, ratio, total
from ..functions.positions import in_blocks, numbered, with_position
from .metrics import MIN_FOR_OUTLIERS, default_catalog

BLOCK = 10_000
CHUNK_METRICS = ("completeness", "outlier_rate", "duplicate_rate")


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """Two hashes that tell rows apart, which of their columns are null included."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("__h0"), F.xxhash64(F.lit("second"), *parts).alias("__h1")]


def sliding_outliers(values: np.ndarray, half: int) -> np.ndarray:
    """Per row, how many of the values in its window [i - half, i + half) lie outside the window's own fences; NaN is missing.

    The window is kept sorted while it slides: a step finds one place to insert and one to delete, and the fences by bisection.
    """
    n, held, out = len(values), [], np.zeros(len(values), np.int64)
    data = values.tolist()
    for i in range(-half + 1, n):
        new, old = i + half - 1, i - half - 1
        if new < n and data[new] == data[new]:
            insort(held, data[new])
        if old >= 0 and data[old] == data[old]:
            del held[bisect_left(held, data[old])]
        if i < 0 or (m := len(held)) < MIN_FOR_OUTLIERS:
            continue
        quartiles = []
        for p in (0.25, 0.75):
            h = (m - 1) * p
            k = int(h)
            quartiles.append(held[k] + (h - k) * (held[min(k + 1, m - 1)] - held[k]))
        q1, q3 = quartiles
        out[i] = bisect_left(held, q1 - 1.5 * (q3 - q1)) + m - bisect_right(held, q3 + 1.5 * (q3 - q1))
    return out


def sliding_distinct(codes: np.ndarray, half: int) -> np.ndarray:
    """Per row, the number of distinct codes in its window."""
    n, seen, distinct, out = len(codes), [0] * (int(codes.max(initial=-1)) + 1), 0, np.zeros(len(codes), np.int64)
    data = codes.tolist()
    for i in range(-half + 1, n):
        new, old = i + half - 1, i - half - 1
        if new < n:
            seen[data[new]] += 1
            distinct += seen[data[new]] == 1
        if old >= 0:
            seen[data[old]] -= 1
            distinct -= seen[data[old]] == 0
        if i >= 0:
            out[i] = distinct
    return out


def sliding_sum(values: np.ndarray, half: int) -> np.ndarray:
    """Per row, the sum over its window."""
    upto = np.concatenate([[0], np.cumsum(values)])
    at = np.arange(len(values))
    return upto[np.minimum(at + half, len(values))] - upto[np.maximum(at - half, 0)]


def window_quality(df: DataFrame, key: str, columns: Sequence[str], size: int = 100) -> DataFrame:
    """key + completeness, outlier_rate and duplicate_rate over the rows [i - size/2, i + size/2) around each row.

    Rows are ordered by a unique numeric key and cut into blocks with an overlap, so no task holds more than a block and
    its overlap; in a block the window slides over the rows once.
    """
    half, cols = max(1, size // 2), list(columns)
    numeric = numeric_columns(df, cols)
    rows = clean(df.select(*dict.fromkeys([key, *cols])))
    filled = total(F.col(c).isNotNull().cast("int") for c in cols)
    rows = rows.select(key, filled.alias("__filled"), *_row_hashes(cols), *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(numeric)])
    placed = in_blocks(with_position(rows, key), "position", BLOCK, half)
    kept = df.schema[key].dataType.simpleString()

    def slide(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position", kind="stable")
        n = sliding_sum(np.ones(len(block), np.int64), half)
        bad = np.zeros(len(block), np.int64)
        for i in range(len(numeric)):
            bad += sliding_outliers(block[f"__v{i}"].to_numpy(float), half)
        codes = pd.MultiIndex.from_frame(block[["__h0", "__h1"]]).factorize()[0]
        out = pd.DataFrame({key: block[key].to_numpy(), "completeness": sliding_sum(block["__filled"].to_numpy(np.int64), half) / (n * len(cols)),
                            "outlier_rate": bad / (n * len(numeric)) if numeric else 0.0, "duplicate_rate": 1 - sliding_distinct(codes, half) / n})
        return out[block["__own"].to_numpy(bool)]

    return placed.groupBy("__block").applyInPandas(slide, f"`{key}` {kept}, completeness double, outlier_rate double, duplicate_rate double")


def _chunked(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    placed = numbered(df, [], [F.col(c).asc_nulls_first() for c in order])
    return placed.withColumn("chunk", F.expr(f"CAST(position DIV {size} AS BIGINT)")).drop("position")


def chunk_quality(df: DataFrame, key: str, columns: Sequence[str], size: int = 100, metrics: Sequence[str] = CHUNK_METRICS) -> DataFrame:
    """chunk + metrics per block of `size` rows in key order.

    Positions are found once. A chunk has at most `size` rows, so its quartiles are taken from its own values and the three
    usual metrics share one shuffle; others are measured by the catalog.
    """
    cols = list(columns)
    rows = _chunked(clean(df.select(*dict.fromkeys([key, *cols]))), [key], size).select("chunk", *cols)
    others = [m for m in metrics if m not in CHUNK_METRICS]
    numeric = numeric_columns(rows, cols)
    own = W.partitionBy("chunk")
    fenced = rows.withColumns({f"__q{i}": F.percentile(F.col(c).cast("double"), [0.25, 0.75]).over(own) for i, c in enumerate(numeric)})
    fences = [(F.expr(f"__q{i}[0] - 1.5D * (__q{i}[1] - __q{i}[0])"), F.expr(f"__q{i}[1] + 1.5D * (__q{i}[1] - __q{i}[0])")) for i in range(len(numeric))]
    n = F.count(F.lit(1))
    bad = total(F.when(F.count(c) >= MIN_FOR_OUTLIERS, count_if((F.col(c).cast("double") < lo) | (F.col(c).cast("double") > hi))).otherwise(0)
                for c, (lo, hi) in zip(numeric, fences))
    known = {"completeness": ratio(total(F.count(c) for c in cols), n * len(cols), 1.0),
             "outlier_rate": ratio(bad, n * max(1, len(numeric)), 0.0),
             "duplicate_rate": 1 - F.size(F.collect_set(F.struct(*cols))) / n}
    out = fenced.groupBy("chunk").agg(n.alias("__n"), *[known[m].alias(m) for m in metrics if m in known]).drop("__n")
    if others:
        out = out.join(default_catalog().compute_wide(rows, others, keys=["chunk"]), "chunk")
    return out.select("chunk", *metrics)


def chunk_means(scored: DataFrame, order: Sequence[str], metrics: Sequence[str], size: int = 100, prefix: str = "pred_") -> DataFrame:
    """chunk, n, and per metric its mean predicted and true value over blocks of `size` rows in the given order.

    Rows carry predictions and truths to their positions, so nothing is joined on a position.
    """
    kept = scored.select(*dict.fromkeys([*order, *metrics, *[prefix + m for m in metrics]]))
    means = [F.avg(c).alias(a) for m in metrics for c, a in ((prefix + m, f"predicted_{m}"), (m, f"true_{m}"))]
    return _chunked(kept, order, size).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), *means)
