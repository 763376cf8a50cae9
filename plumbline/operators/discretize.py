"""Quality-aware merging of neighbouring bins, and the quality of the result.

The order of merges does not depend on the stopping threshold, so one Spark job per attribute set
measures everything a merge may need, and the complete merge history is worked out once. Every
threshold is then a prefix of that history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..core import COUNT, clean, count_rows, materialize, numeric_columns, quoted, same_keys
from ..functions.quantiles import sketched
from .binned import union_metrics
from .bins import (BIN_METRICS, assign_bins, bin_quality, by_bin, fit_boundaries, row_groups,
                   unpivot_quality)
from .metrics import MIN_FOR_KURTOSIS, MIN_FOR_OUTLIERS, MIN_FOR_SKEW
from .rows import ROW_METRICS, RowMetricsModel, fit_row_metrics

# Search range and limits of the threshold search.
FIRST_THRESHOLD, LOWEST_THRESHOLD, HIGHEST_THRESHOLD = 0.01, 0.0001, 0.1
MAX_HOMOGENEITY, MIN_SEPARATION = 0.01, 0.01
FEW = 460                # up to so many values, every value is a cell of its own
# Cells of a column of many values: this many, or one per so many rows if that is more. The values of a cell are read once per
# union of bins that needs it, so cells are fine: their counts are cheaper than their values.
CELLS, PER_CELL = 4096, 25_000


# -- on tables of bins ---------------------------------------------------------------------------

def merge_cost(bins: DataFrame, weights: dict[str, float] | None = None, size_weight: str = "rows") -> DataFrame:
    """Cost of merging every bin with its right neighbour: (attr, left_bin, right_bin, cost).

    `size_weight='share'` uses shares of the table instead of row counts, for scale-free thresholds.
    """
    names = list(weights) if weights else list(BIN_METRICS)
    w = weights or {m: 1.0 / len(names) for m in names}
    order = W.partitionBy("attr").orderBy("bin_id")
    pair = bins.select("attr", F.col("bin_id").alias("left_bin"), F.lead("bin_id").over(order).alias("right_bin"),
                       F.col("n").cast("double").alias("n1"), F.lead("n").over(order).cast("double").alias("n2"),
                       F.col("quality").alias("q1"), F.lead("quality").over(order).alias("q2"),
                       F.sum("n").over(W.partitionBy("attr")).alias("all_rows"))
    gaps = " + ".join(f"{float(w[m])!r}D * pow(coalesce(q1['{m}'], 0D) - coalesce(q2['{m}'], 0D), 2)" for m in names)
    size = "n1 * n2 / (n1 + n2)" + (" / all_rows" if size_weight == "share" else "")
    return pair.filter("right_bin IS NOT NULL").selectExpr("attr", "left_bin", "right_bin", f"{size} * ({gaps}) AS cost")


def separation(bins: DataFrame) -> DataFrame:
    """(attr, separation): mean over metrics of the variance between bins."""
    per = unpivot_quality(bins).groupBy("attr", "metric").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    return per.groupBy("attr").agg(F.avg("v").alias("separation"))


def homogeneity(df: DataFrame, boundaries: dict[str, Sequence[float]], metrics: Sequence[str] = ROW_METRICS) -> DataFrame:
    """(attr, homogeneity): mean over metrics and bins of the variance of row quality within a bin."""
    rows = by_bin(assign_bins(df, boundaries, null_bin=None), list(boundaries), metrics)
    per = rows.groupBy("attr", "bin_id").agg(*[F.coalesce(F.var_samp(m), F.lit(0.0)).alias(m) for m in metrics])
    mean = " + ".join(f"avg({m})" for m in metrics)
    return per.groupBy("attr").agg(F.expr(f"({mean}) / {len(metrics)}").alias("homogeneity"))


# -- merge history -------------------------------------------------------------------------------

@dataclass
class Bin:
    first: int          # initial bins first..last make up this bin
    last: int
    lower: float
    upper: float
    n: int
    quality: dict[str, float]
    spread: dict[str, tuple[float, float, float]] = field(default_factory=dict)   # row metric -> n, sum, squares


@dataclass
class MergeHistory:
    """Initial bins of one attribute and the merges in the order they happen."""

    attr: str
    initial: list[Bin]
    merges: list[tuple[float, Bin]]     # cost, resulting bin

    def bins(self, threshold: float, skip: int = 0) -> list[Bin]:
        """Bins after merging until the first cost above the threshold."""
        taken = self._prefix(threshold)
        return self.after(max(taken, skip))

    def _prefix(self, threshold: float) -> int:
        for i, (cost, _) in enumerate(self.merges):
            if cost > threshold:
                return i
        return len(self.merges)

    def after(self, steps: int) -> list[Bin]:
        left = {b.first: b for b in self.initial}
        for _, b in self.merges[:steps]:
            for f in [f for f in left if b.first <= f <= b.last]:
                del left[f]
            left[b.first] = b
        return [left[f] for f in sorted(left)]


def _sketch_frame(df: DataFrame, boundaries: dict[str, list[float]], numeric: Sequence[str],
                  cells: dict[str, list[float]], scale: dict[str, tuple[float, float]]) -> DataFrame:
    """(attr, bin_id, col, cell, n, low, high, z1..z4) of counted rows: sums that add up over neighbouring bins.

    One shuffle of counts; its size depends on the number of bins and cells only.
    """
    binned = assign_bins(df, boundaries, null_bin=None)
    celled = assign_bins(binned, cells, null_bin=None, prefix="__cell_")
    bins = ", ".join(f"struct('{a}' AS attr, {quoted('bin_' + a)} AS bin_id)" for a in boundaries)
    values = ", ".join(
        f"struct({i} AS col, {quoted('__cell_' + c)} AS cell, CAST({quoted(c)} AS DOUBLE) AS v)"
        for i, c in enumerate(numeric) if c in cells)
    flat = celled.selectExpr(f"inline(array({values}))", f"array({bins}) AS __bins", COUNT).filter("cell IS NOT NULL")
    mid, dev = ("array(" + ", ".join(f"{scale[c][k]!r}D" for c in numeric) + ")[col]" for k in (0, 1))
    flat = flat.selectExpr("col", "cell", "v", f"(v - {mid}) / {dev} AS z", COUNT, "__bins")
    flat = flat.selectExpr("col", "cell", "v", "z", f"{COUNT} * z * z AS zz", COUNT, "inline(__bins)").filter("bin_id IS NOT NULL")
    return flat.groupBy("attr", "bin_id", "col", "cell").agg(
        F.sum(COUNT).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.expr(f"{COUNT} * z")).alias("z1"),
        F.sum("zz").alias("z2"), F.expr("sum(zz * z)").alias("z3"), F.expr("sum(zz * z * z)").alias("z4"))


HISTORY_SCHEMA = ("attr string, step int, first_bin int, last_bin int, cost double, n bigint, metric string, "
                  "value double, row_n double, row_sum double, row_squares double")


def merge_history(df: DataFrame, boundaries: dict[str, list[float]], columns: Sequence[str] | None = None,
                  weights: dict[str, float] | None = None, size_weight: str = "rows",
                  row_model: RowMetricsModel | None = None, target: str = "table", configs: dict[str, dict] | None = None,
                  catalog: Catalog | None = None) -> DataFrame:
    """The whole merge history of every attribute as rows; step 0 holds the initial bins.

    Equal rows are counted first, or come counted (with COUNT). `configs` adds metrics of the catalog (those with a State),
    over all columns of `df`, to the quality of the bins; its rows must not be counted then.

    `target='table'` measures a bin with the configuration-free metrics, `'row'` with the means of
    the row metrics. Every quartile is exact: columns with few values are counted value by value, for
    the others `range_outliers` looks up all unions of neighbouring bins beforehand.
    """
    rows = clean(df)
    cols = list(columns or (c for c in df.columns if c != COUNT))
    attrs = list(boundaries)
    df = count_rows(df, list(dict.fromkeys([*cols, *attrs])))
    numeric = numeric_columns(df, cols)
    model = row_model or fit_row_metrics(df.select(*cols, COUNT))
    scored = model.transform(df.select(*dict.fromkeys([*cols, *attrs]), COUNT))
    binned = assign_bins(scored, boundaries, null_bin=None)
    spread = by_bin(binned, attrs, [*ROW_METRICS, COUNT]).groupBy("attr", "bin_id").agg(
        F.sum(COUNT).alias("rows"), *[F.expr(f"sum({COUNT} * {m})").alias(f"s_{m}") for m in ROW_METRICS],
        *[F.expr(f"sum({COUNT} * {m} * {m})").alias(f"q_{m}") for m in ROW_METRICS])
    none = F.lit(None)
    head = spread.select("attr", "bin_id", F.lit(-1).alias("col"), F.lit(-1).alias("cell"), F.col("rows").alias("n"),
                         *[none.cast("double").alias(c) for c in ("low", "high", "z1", "z2", "z3", "z4")],
                         F.array(*[F.col(f"{p}_{m}") for m in ROW_METRICS for p in ("s", "q")]).alias("rowq"))
    parts = [head]
    names = list(BIN_METRICS) if target == "table" else list(ROW_METRICS)
    if target == "table":
        cells, wide = cell_edges(df, numeric)
        moments = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(numeric)
                           for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scale = {c: (moments[f"m{i}"] or 0.0, moments[f"s{i}"] or 1.0) for i, c in enumerate(numeric)}
        groups = row_groups(binned.drop(*ROW_METRICS), attrs, cols)
        parts.append(groups.select("attr", "bin_id", F.lit(-2).alias("col"), F.lit(-2).alias("cell"), F.col("distinct_rows").alias("n"),
                                   F.col("filled").cast("double").alias("low"), *[none.cast("double").alias(c) for c in ("high", "z1", "z2", "z3", "z4")],
                                   none.cast("array<double>").alias("rowq")))
        # Moments need no cells, so a wide column has a single one here.
        flat = {c: [0.0, 0.0] if c in wide else cells[c] for c in cells}
        parts.append(_sketch_frame(df, boundaries, numeric, flat, scale).withColumn("rowq", none.cast("array<double>")))
        if wide:
            found = range_outliers(df, boundaries, {c: cells[c] for c in wide})
            at = {c: i for i, c in enumerate(numeric)}
            places = "map(" + ", ".join(f"'{c}', {at[c]}D" for c in wide) + ")[col]"
            parts.append(found.select("attr", F.col("first").alias("bin_id"), F.lit(-3).alias("col"), F.col("last").alias("cell"), F.col("outliers").alias("n"),
                                      F.expr(places).alias("low"), *[none.cast("double").alias(c) for c in ("high", "z1", "z2", "z3", "z4")],
                                      none.cast("array<double>").alias("rowq")))
    extra = list(configs or {})
    if extra:
        found = union_metrics(rows, boundaries, configs, catalog)
        places = "map(" + ", ".join(f"'{m}', {i}L" for i, m in enumerate(extra)) + ")[metric]"
        parts.append(found.select("attr", F.col("first").alias("bin_id"), F.lit(-4).alias("col"), F.col("last").alias("cell"), F.expr(places).alias("n"),
                                  F.col("value").alias("low"), *[none.cast("double").alias(c) for c in ("high", "z1", "z2", "z3", "z4")],
                                  none.cast("array<double>").alias("rowq")))
        names += extra
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    w = weights or {m: 1.0 / len(names) for m in names}
    n_cols, n_num = len(cols), len(numeric)
    looked_up = {numeric.index(c) for c in wide} if target == "table" else set()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solve(pdf, names, w, size_weight, n_cols, n_num, looked_up, extra)

    # One group per attribute; its rows are sums per (bin, column, cell), never table rows.
    return table.groupBy("attr").applyInPandas(solve, HISTORY_SCHEMA)


def cell_edges(df: DataFrame, numeric: Sequence[str], cells: int = CELLS) -> tuple[dict[str, list[float]], list[str]]:
    """Cell boundaries per column, and the wide columns: one cell per value if there are few values, else
    equal-frequency cells.
    """
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.approx_count_distinct(c).alias(c) for c in numeric]).first()
    fine = max(cells, -(-counts["__rows"] // PER_CELL))
    probs = [i / fine for i in range(fine + 1)]
    few = [c for c in numeric if counts[c] <= FEW]
    out: dict[str, list[float]] = {}
    if few:
        got = df.select(*[F.collect_set(F.col(c).cast("double")).alias(c) for c in few]).first()
        for c in few:
            if got[c]:
                vals = sorted(got[c])
                out[c] = [*vals, vals[-1]] if len(vals) > 1 else vals * 2
    many = [c for c in numeric if c not in few]
    if many:
        # Cells only have to be fine, not exact: the sketch's own ranks are good enough. More cells on more rows keep the
        # values that one task ranks in a cell bounded.
        at = "array(" + ", ".join(f"{p:.9f}D" for p in probs) + ")"
        row = sketched(df, many, [], 4000).selectExpr(
            *[f"kll_sketch_get_quantile_double(IF(n{i} > 0, k{i}, NULL), {at}) AS e{i}" for i in range(len(many))]).first()
        for i, c in enumerate(many):
            if row[i]:
                out[c] = sorted(set(row[i]))
    return out, [c for c in many if c in out]


RANGE_KEYS = ["a", "col", "first", "last"]


def range_outliers(df: DataFrame, boundaries: dict[str, list[float]], cells: dict[str, list[float]]) -> DataFrame:
    """(attr, col, first, last, outliers): exact outliers of each column in every union of neighbouring bins.

    The values of (bin, column) are counted once and written. Counts per cell tell in which cell every
    wanted order statistic and every fence lies; only the values of these cells are then read. With few
    values in a union there are no outliers and no row.
    """
    attrs, cols = list(boundaries), list(cells)
    df = count_rows(df, list(dict.fromkeys([*cols, *[a for a in attrs if a in df.columns]])))
    binned = assign_bins(df.select(*dict.fromkeys([*cols, *[a for a in attrs if a in df.columns]]), COUNT), boundaries, null_bin=None)
    celled = assign_bins(binned, cells, null_bin=None, prefix="__cell_")
    bins = ", ".join(f"struct({i} AS a, {quoted('bin_' + a)} AS bin_id)" for i, a in enumerate(attrs))
    values = ", ".join(f"struct({i} AS col, {quoted('__cell_' + c)} AS cell, CAST({quoted(c)} AS DOUBLE) AS v)" for i, c in enumerate(cols))
    flat = celled.selectExpr(f"inline(array({values}))", f"array({bins}) AS __bins", COUNT).filter("cell IS NOT NULL")
    flat = flat.selectExpr("col", "cell", "v", COUNT, "inline(__bins)").filter("bin_id IS NOT NULL")
    counts = materialize(flat.groupBy("a", "bin_id", "col", "cell", "v").agg(F.sum(COUNT).alias("n")))
    hist = materialize(counts.groupBy("a", "bin_id", "col", "cell").agg(F.sum("n").alias("n")))
    edges = [cells[c] for c in cols]

    wanted = materialize(hist.groupBy("a", "col").applyInPandas(
        _wanted, "a int, col int, first int, last int, p double, cell int, k1 bigint, k2 bigint"))
    rows = _in_cells(counts, wanted)
    order = W.partitionBy(*RANGE_KEYS, "p", "cell").orderBy("v")     # one cell of one union; equal values are peers
    ranked = rows.withColumn("upto", F.sum("n").over(order))
    quarts = ranked.groupBy(*RANGE_KEYS, "p").agg(F.expr("min(IF(k1 >= 0 AND upto > k1, v, NULL)) AS v1"),
                                                   F.expr("min(IF(k2 >= 0 AND upto > k2, v, NULL)) AS v2"))

    def fences(h: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _fences(h, q, edges)

    limits = materialize(hist.groupBy("a", "col").cogroup(quarts.groupBy("a", "col")).applyInPandas(
        fences, "a int, col int, first int, last int, whole bigint, lo double, hi double, cells array<int>"))
    parts = _in_cells(counts, limits.withColumn("cell", F.explode("cells"))).filter("v < lo OR v > hi")
    found = limits.select(*RANGE_KEYS, F.col("whole").alias("n")).unionByName(parts.select(*RANGE_KEYS, "n"))
    names = lambda xs, i: "array(" + ", ".join(f"'{x}'" for x in xs) + f")[{i}]"
    return found.groupBy(*RANGE_KEYS).agg(F.sum("n").alias("outliers")).selectExpr(
        f"{names(attrs, 'a')} AS attr", f"{names(cols, 'col')} AS col", "first", "last", "outliers")


def _in_cells(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The counted values in the wanted cell of every union of bins."""
    return same_keys(counts, wanted, ["a", "col", "cell"]).filter("bin_id BETWEEN first AND last")


def _per_bin(hist: pd.DataFrame) -> np.ndarray:
    """Rows per cell (columns) in the bins before bin i (rows)."""
    per = np.zeros((hist["bin_id"].max() + 2, hist["cell"].max() + 1), dtype=np.int64)
    np.add.at(per, (hist["bin_id"].to_numpy() + 1, hist["cell"].to_numpy()), hist["n"].to_numpy())
    return np.cumsum(per, axis=0)


def _wanted(hist: pd.DataFrame) -> pd.DataFrame:
    """Cell and place within it of both neighbours of each quartile; -1: not in this cell."""
    before, out = _per_bin(hist), []
    for first in range(len(before) - 1):
        for last in range(first, len(before) - 1):
            upto = np.cumsum(before[last + 1] - before[first])
            n = int(upto[-1])
            if n < MIN_FOR_OUTLIERS:
                continue
            for p in (0.25, 0.75):
                k = int(np.floor((n - 1) * p))
                c1, c2 = (int(np.searchsorted(upto, x, side="right")) for x in (k, k + 1))
                k1, k2 = (x - (int(upto[c - 1]) if c else 0) for x, c in ((k, c1), (k + 1, c2)))
                out += [(first, last, p, c1, k1, k2)] if c1 == c2 else [(first, last, p, c1, k1, -1), (first, last, p, c2, -1, k2)]
    found = pd.DataFrame(out, columns=["first", "last", "p", "cell", "k1", "k2"])
    return found.assign(a=hist["a"].iloc[0], col=hist["col"].iloc[0])[["a", "col", *found.columns]]


def _fences(hist: pd.DataFrame, quarts: pd.DataFrame, edges: Sequence[Sequence[float]]) -> pd.DataFrame:
    """Fences of every union, the rows in cells wholly outside, and the cells the fences cut."""
    before, out, near = _per_bin(hist), [], {}
    a, col = int(hist["a"].iloc[0]), int(hist["col"].iloc[0])
    inner = np.asarray(edges[col][1:-1], float)
    for r in quarts.itertuples():
        near[r.first, r.last, r.p] = (r.v1, r.v2)
    for first, last in dict.fromkeys((f, l) for f, l, _ in near):
        per = before[last + 1] - before[first]
        n, q = int(per.sum()), []
        for p in (0.25, 0.75):
            v1, v2 = near[first, last, p]
            h = (n - 1) * p
            q.append(v1 + (h - np.floor(h)) * (v2 - v1))
        lo, hi = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
        low, high = (int(np.searchsorted(inner, x, side="right")) for x in (lo, hi))
        out.append((a, col, first, last, int(per[:low].sum() + per[high + 1:].sum()), lo, hi, sorted({low, high})))
    return pd.DataFrame(out, columns=["a", "col", "first", "last", "whole", "lo", "hi", "cells"])


class _Sums:
    """Sums of one or several neighbouring bins."""

    def __init__(self, rows, distinct, filled, cell, row_sums):
        self.rows, self.distinct, self.filled, self.cell, self.row_sums = rows, distinct, filled, cell, row_sums

    def __add__(self, o: "_Sums") -> "_Sums":
        cell = dict(self.cell)
        for c, m in o.cell.items():
            cell[c] = _add_cells(cell[c], m) if c in cell else m
        return _Sums(self.rows + o.rows, self.distinct + o.distinct, self.filled + o.filled, cell, self.row_sums + o.row_sums)


def _add_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns: cell, n, low, high, z1..z4. Same cells are added, the order of cells is kept."""
    both = np.concatenate([a, b])
    ids, at = np.unique(both[:, 0], return_inverse=True)
    out = np.zeros((len(ids), both.shape[1]))
    out[:, 0] = ids
    for j in (1, 4, 5, 6, 7):
        np.add.at(out[:, j], at, both[:, j])
    out[:, 2], out[:, 3] = np.inf, -np.inf
    np.minimum.at(out[:, 2], at, both[:, 2])
    np.maximum.at(out[:, 3], at, both[:, 3])
    return out


def _order_stat(m: np.ndarray, k: int) -> float:
    """k-th smallest value (from 0); every cell holds one value."""
    return m[int(np.searchsorted(np.cumsum(m[:, 1]), k, side="right")), 2]


def _quartile(m: np.ndarray, p: float) -> float:
    h = (m[:, 1].sum() - 1) * p
    k = int(np.floor(h))
    a = _order_stat(m, k)
    return a if h == k else a + (h - k) * (_order_stat(m, k + 1) - a)


def _outliers(m: np.ndarray) -> float:
    if m[:, 1].sum() < MIN_FOR_OUTLIERS:
        return 0.0
    q1, q3 = _quartile(m, 0.25), _quartile(m, 0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return float(m[(m[:, 2] < lo) | (m[:, 2] > hi), 1].sum())


def _shapes(m: np.ndarray) -> tuple[float | None, float | None]:
    n = m[:, 1].sum()
    s1, s2, s3, s4 = (m[:, j].sum() / n for j in (4, 5, 6, 7))
    m2 = s2 - s1 * s1
    if m[:, 2].min() == m[:, 3].max() or m2 <= 0:
        return None, None
    m3 = s3 - 3 * s1 * s2 + 2 * s1 ** 3
    m4 = s4 - 4 * s1 * s3 + 6 * s1 * s1 * s2 - 3 * s1 ** 4
    return (abs(m3 / m2 ** 1.5) if n >= MIN_FOR_SKEW else None, abs(m4 / m2 ** 2 - 3) if n >= MIN_FOR_KURTOSIS else None)


def _measure(s: _Sums, names: Sequence[str], n_cols: int, n_num: int, looked_up: dict[int, float]) -> dict[str, float]:
    if names[0] in ROW_METRICS:
        return {m: s.row_sums[2 * i] / s.rows for i, m in enumerate(ROW_METRICS)}
    shapes = [_shapes(m) for m in s.cell.values()]
    mean = lambda i: float(np.mean([x[i] for x in shapes if x[i] is not None] or [0.0]))
    completeness = s.filled / (s.rows * n_cols)
    outliers = sum(looked_up[c] if c in looked_up else _outliers(m) for c, m in s.cell.items()) / (s.rows * n_num) if n_num else 0.0
    return {"completeness": completeness, "outlier_rate": outliers, "duplicate_rate": (s.rows - s.distinct) / s.rows,
            "distribution_skewness": mean(0), "distribution_kurtosis": mean(1),
            "overall_quality": 0.5 * completeness + 0.5 * (1 - outliers)}


def _solve(pdf: pd.DataFrame, names, weights, size_weight, n_cols, n_num, looked_up=frozenset(), extra=()) -> pd.DataFrame:
    """Merge history of one attribute from its sums per bin."""
    attr, sums = pdf["attr"].iloc[0], {}
    ranges = pdf[pdf["col"] == -3]
    outside = {(int(r.low), r.bin_id, r.cell): float(r.n) for r in ranges.itertuples()}
    unions: dict[tuple[int, int], dict[str, float]] = {}
    for r in pdf[pdf["col"] == -4].itertuples():
        unions.setdefault((r.bin_id, r.cell), {})[extra[int(r.n)]] = float(r.low)

    def measured(first, last, s):
        own = _measure(s, names, n_cols, n_num, {c: outside.get((c, first, last), 0.0) for c in looked_up})
        return own | unions.get((first, last), {})

    for b, g in pdf[pdf["col"] > -3].groupby("bin_id", sort=True):
        head, dist, cells = g[g["col"] == -1].iloc[0], g[g["col"] == -2], g[g["col"] >= 0]
        per = {int(c): x.sort_values("cell")[["cell", "n", "low", "high", "z1", "z2", "z3", "z4"]].to_numpy(float)
               for c, x in cells.groupby("col")}
        rows = int(head["n"])
        sums[int(b)] = _Sums(rows, int(dist["n"].iloc[0]) if len(dist) else rows, float(dist["low"].iloc[0]) if len(dist) else 0.0,
                             per, np.asarray(head["rowq"], float))
    total = sum(s.rows for s in sums.values())
    live = [(b, b, s, measured(b, b, s)) for b, s in sorted(sums.items())]
    out = []

    def record(step, cost, item):
        first, last, s, q = item
        for i, m in enumerate(dict.fromkeys([*names, *ROW_METRICS])):
            j = ROW_METRICS.index(m) if m in ROW_METRICS else None
            out.append((attr, step, first, last, cost, s.rows, m, q.get(m), float(s.rows),
                        None if j is None else s.row_sums[2 * j], None if j is None else s.row_sums[2 * j + 1]))

    def cost(a, b):
        size = a[2].rows * b[2].rows / (a[2].rows + b[2].rows)
        gap = sum(w * (a[3].get(m, 0.0) - b[3].get(m, 0.0)) ** 2 for m, w in weights.items())
        return size * gap / (total if size_weight == "share" else 1)

    for item in live:
        record(0, None, item)
    costs = [cost(a, b) for a, b in zip(live, live[1:])]
    step = 0
    while len(live) > 1:
        i = int(np.argmin(costs))           # the leftmost of equal costs
        step += 1
        s = live[i][2] + live[i + 1][2]
        new = (live[i][0], live[i + 1][1], s, measured(live[i][0], live[i + 1][1], s))
        record(step, costs[i], new)
        live[i:i + 2] = [new]
        costs[i:i + 1] = []
        if i > 0:
            costs[i - 1] = cost(live[i - 1], live[i])
        if i + 1 < len(live):
            costs[i] = cost(live[i], live[i + 1])
    return pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY_SCHEMA.split(", ")])


def collect_history(history: DataFrame, boundaries: dict[str, list[float]]) -> dict[str, MergeHistory]:
    """The history as plain objects: two rows per initial bin and metric, independent of the table's size."""
    out: dict[str, MergeHistory] = {}
    pdf = history.toPandas().sort_values(["attr", "step", "first_bin"], kind="stable")
    for attr, g in pdf.groupby("attr", sort=False):
        bs, h = boundaries[attr], MergeHistory(attr, [], [])
        for (step, first, last), rows in g.groupby(["step", "first_bin", "last_bin"], sort=True):
            quality = {r.metric: float(r.value) for r in rows.itertuples() if pd.notna(r.value)}
            spread = {r.metric: (float(r.row_n), float(r.row_sum), float(r.row_squares)) for r in rows.itertuples() if pd.notna(r.row_sum)}
            b = Bin(int(first), int(last), float(bs[first]), float(bs[last + 1]), int(rows["n"].iloc[0]), quality, spread)
            if step == 0:
                h.initial.append(b)
            else:
                h.merges.append((float(rows["cost"].iloc[0]), b))
        out[attr] = h
    return {a: out[a] for a in boundaries if a in out}


def fit_history(df: DataFrame, columns: Sequence[str] | None = None, n_bins: int = 20,
                boundaries: dict[str, list[float]] | None = None, **options) -> dict[str, MergeHistory]:
    bs = boundaries or fit_boundaries(df, columns, n_bins)
    return collect_history(merge_history(df, bs, **options), bs)


# -- reading the history ---------------------------------------------------------------------------

@dataclass
class Discretization:
    attr: str
    bins: list[Bin]
    homogeneity: float
    separation: float
    threshold: float

    def acceptable(self, max_homogeneity: float = MAX_HOMOGENEITY, min_separation: float = MIN_SEPARATION) -> bool:
        return self.homogeneity <= max_homogeneity and self.separation >= min_separation


def assess(attr: str, bins: list[Bin], threshold: float, homogeneity: str = "rows") -> Discretization:
    """Homogeneity from the variance of row quality within bins ('bin' gives the constant 0)."""
    h = 0.0
    if homogeneity == "rows":
        spreads = [[max(0.0, (q - s * s / n) / (n - 1)) if n > 1 else 0.0 for n, s, q in b.spread.values()] for b in bins]
        h = float(np.mean(spreads)) if spreads and spreads[0] else 0.0
    names = list(bins[0].quality) if bins else []
    values = [[b.quality.get(m, 0.0) for b in bins] for m in names]
    s = float(np.mean([np.var(v, ddof=1) for v in values])) if len(bins) > 1 and names else 0.0
    return Discretization(attr, bins, h, s, threshold)


def discretize(history: MergeHistory, threshold: float = FIRST_THRESHOLD, homogeneity: str = "rows") -> Discretization:
    return assess(history.attr, history.bins(threshold), threshold, homogeneity)


def discretize_adaptive(history: MergeHistory, rounds: int = 10, first: float = FIRST_THRESHOLD,
                        max_homogeneity: float = MAX_HOMOGENEITY, min_separation: float = MIN_SEPARATION,
                        homogeneity: str = "rows") -> Discretization:
    """Halve the distance to the upper limit while bins are too mixed, to the lower one while they
    are too alike; the first acceptable result, or the one with the largest S - H."""
    low, high, t, best = LOWEST_THRESHOLD, HIGHEST_THRESHOLD, first, None
    for _ in range(rounds):
        d = discretize(history, t, homogeneity)
        if d.acceptable(max_homogeneity, min_separation):
            return d
        if best is None or d.separation - d.homogeneity > best.separation - best.homogeneity:
            best = d
        if d.homogeneity > max_homogeneity:
            low, t = t, (t + high) / 2
        else:
            high, t = t, (low + t) / 2
    return best


def discretization_frame(spark, found: Sequence[Discretization], **limits) -> DataFrame:
    rows = [(d.attr, len(d.bins), d.homogeneity, d.separation, d.threshold, d.acceptable(**limits)) for d in found]
    return spark.createDataFrame(rows, "attr string, n_bins int, homogeneity double, separation double, threshold double, acceptable boolean")


def bins_frame(spark, found: Sequence[Discretization]) -> DataFrame:
    """The bins table of finished discretizations, numbered from 0."""
    rows = [(d.attr, i, b.lower, b.upper, b.n, b.quality) for d in found for i, b in enumerate(d.bins)]
    return spark.createDataFrame(rows, "attr string, bin_id int, lower double, upper double, n bigint, quality map<string,double>")


def edges_of(d: Discretization) -> list[float]:
    return [*[b.lower for b in d.bins], d.bins[-1].upper]


def merged_bin_quality(df: DataFrame, found: Sequence[Discretization], columns: Sequence[str] | None = None,
                       configs: dict[str, dict] | None = None, catalog: Catalog | None = None) -> DataFrame:
    """Exact metrics of the merged bins, measured again on their rows."""
    return bin_quality(df, {d.attr: edges_of(d) for d in found}, columns, configs, catalog)


def threshold_sweep(spark, histories: Sequence[MergeHistory], thresholds: Sequence[float], homogeneity: str = "rows") -> DataFrame:
    """One row per attribute and threshold, with S - H."""
    found = [discretize(h, t, homogeneity) for h in histories for t in thresholds]
    return discretization_frame(spark, found).withColumn("score", F.col("separation") - F.col("homogeneity"))


