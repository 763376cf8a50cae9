"""Correlation of numeric columns over their pairwise complete rows, one row per pair."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import numeric_columns, quoted, shared_dir, spread
from ..functions.quantiles import running_counts, sketched

RANGE = 1_000_000       # rows between two cuts that one task puts in order
CELLS, SKETCH = 256, 8000       # pieces that a column is cut into at least, and the parameter of the sketch that cuts it
BATCH = 500_000         # rows that are dealt out together
HELD = 8_000_000        # sizes of cells that a task holds before it sends them
ABSENT = np.iinfo(np.int64).min
TAU_SUMS = ["pair", "size", "tx", "ty", "txy", "discordant"]
# Ranks of more values are joined by sorting: their files look small to Spark, but the driver would hold them unpacked.
SENT = 100_000


def correlation(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) for every pair; NULL where a column is constant."""
    cols = numeric_columns(df, columns)
    df = df.select(*cols)
    if method == "pearson":
        return _named(_pearson(_pairs(spread(df), cols)), cols)
    if method == "spearman":
        return _named(_spearman(df, cols), cols)
    if method == "kendall":
        return _named(_kendall(df, cols), cols)
    raise ValueError(f"unknown correlation {method!r}")


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pair, x, y) of the rows where both values are present."""
    cells = ", ".join(f"struct({p} AS pair, CAST({quoted(a)} AS DOUBLE) AS x, CAST({quoted(b)} AS DOUBLE) AS y)"
                      for p, (a, b) in enumerate(combinations(cols, 2)))
    return df.selectExpr(f"inline(array({cells}))").filter("x IS NOT NULL AND y IS NOT NULL")


def _pearson(pairs: DataFrame) -> DataFrame:
    # corr() fails on a constant column, and a rounding rest may hide that a column is constant.
    return pairs.sparkSession.sql(
        "SELECT pair, IF(min(x) < max(x) AND min(y) < max(y), try_divide(covar_pop(x, y), stddev_pop(x) * stddev_pop(y)), NULL) "
        "AS correlation FROM {p} GROUP BY pair", p=pairs)


def _named(result: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = list(combinations(cols, 2))
    left = "array(" + ", ".join(f"'{a}'" for a, _ in names) + ")"
    right = "array(" + ", ".join(f"'{b}'" for _, b in names) + ")"
    return result.selectExpr(f"{left}[pair] AS column_a", f"{right}[pair] AS column_b", "correlation")


def _spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values are ranked once per column, not once per pair, and rows meet the ranks of all their values.

    A pair ranks the rows where both values are present. A partner without missing values takes no row away, so a value has
    one rank among all rows of its column, and one more per other column that has missing values.
    """
    spark = df.sparkSession
    rows = df.selectExpr(*[f"CAST({quoted(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(cols)])
    filled = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"v{i}").alias(f"v{i}") for i in range(len(cols))]).first()
    live = [i for i in range(len(cols)) if filled[f"v{i}"]]
    gaps = [i for i in live if filled[f"v{i}"] < filled["rows"]]
    if not live:
        return spark.createDataFrame([], "pair int, correlation double")
    cells = ", ".join(f"struct({i} AS col, v{i} AS v)" for i in live)
    values = rows.selectExpr(f"inline(array({cells}))", *[f"v{j} IS NOT NULL AS h{j}" for j in gaps]).filter("v IS NOT NULL")
    counts = values.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"h{j}").alias(f"n{j}") for j in gaps])
    # Equal values share the mean of their ranks; d is twice its distance from the mean over all ranks, a whole number.
    ranks = running_counts(counts, ["col"], "v", "n", [f"n{j}" for j in gaps]).selectExpr(
        "col", "v", "n", "2 * before + n - size AS d",
        *[x for j in gaps for x in (f"n{j}", f"2 * before_n{j} + n{j} - size_n{j} AS d{j}")])
    # One folder per column, so that Spark knows the size of each and sends the small ones to the rows.
    path = shared_dir(spark, "ranks")
    ranks.write.partitionBy("col").parquet(path)
    ranks = spark.read.schema(ranks.schema).parquet(path)
    per = {r["col"]: r for r in ranks.groupBy("col").agg(
        F.count(F.lit(1)).alias("values"), *[F.expr(x) for j in ["", *gaps] for x in (
            f"sum(n{j}) AS n{j}", f"sum(n{j} * CAST(d{j} AS DOUBLE) * d{j}) AS dd{j}")]).collect()}
    # Columns of many values first: rows are shuffled for these, and every column met makes them wider.
    for i in sorted(live, key=lambda i: (-per[i]["values"], i)):
        own = spark.read.schema(ranks.drop("col").schema).parquet(f"{path}/col={i}").selectExpr(
            "v", f"d AS d{i}_", *[f"d{j} AS d{i}_{j}" for j in gaps if j != i])
        own = own.hint("merge") if per[i]["values"] > SENT else own
        rows = rows.join(own, rows[f"v{i}"] == own["v"], "left").drop("v", f"v{i}")
    pairs = []
    for p, (a, b) in enumerate(combinations(range(len(cols)), 2)):
        if a in live and b in live:
            x, y = (f"{j}" if j in gaps else "" for j in (b, a))
            if per[a][f"n{x}"]:
                pairs.append((p, f"CAST(d{a}_{x} AS DOUBLE) * d{b}_{y}", per[a][f"dd{x}"], per[b][f"dd{y}"]))
    if not pairs:
        return spark.createDataFrame([], "pair int, correlation double")
    sums = rows.agg(*[F.expr(f"sum({xy})").alias(f"s{p}") for p, xy, _, _ in pairs])
    return sums.selectExpr("inline(array(" + ", ".join(
        f"struct({p} AS pair, try_divide(s{p}, sqrt({xx!r}D) * sqrt({yy!r}D)) AS correlation)" for p, _, xx, yy in pairs) + "))")


def _kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """tau-b. Discordant pairs are counted, never listed, and rows are dealt once per column, not once per pair.

    Cuts divide every column into cells: an interval between two cuts, or a cut itself, whose rows are all tied. Two rows in
    different cells of both columns are ordered by the cells, so the sizes of the cells of a pair tell their number. Rows of one
    interval meet in one task, which orders them against every other column: one column of a pair with its intervals' rows
    compares all values of the other, the other one only its cells, since rows that share intervals of both were counted by the
    first. A value that many rows share is a cut, and no task gathers its rows. Any cuts give the same result.
    """
    names = list(combinations(range(len(cols)), 2))
    number = {p: i for i, p in enumerate(names)}
    rows = df.selectExpr(*[f"CAST({quoted(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(cols)])
    cuts, order = _cuts(rows, [df.schema[c].dataType for c in cols])
    widths = [2 * len(c) + 2 for c in cuts]
    place = {i: at for at, i in enumerate(order)}
    least, most, pairs = BATCH, HELD, [-1 - p for p in range(len(names))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, entries = [[] for _ in names], 0
        for part in _gathered(batches, least):
            keys = [_keys(part.column(i)) for i in range(len(cols))]
            cells = [_cells(k, c) for k, c in zip(keys, cuts)]
            for own, (a, b) in zip(sizes, names):
                own.append(_tally(cells[a].astype(np.int64) * widths[b] + cells[b]))
                entries += len(own[-1][0])
            if entries >= most:
                yield _batch(pairs, [0] * len(pairs), [pickle.dumps(_merged(x), 5) for x in sizes])
                sizes, entries = [[] for _ in names], 0
            for i in range(len(cols)):
                own = np.flatnonzero(cells[i] & 1)
                own = own[np.argsort(cells[i][own], kind="stable")]
                if len(own):
                    sent = [keys[j][own] if place[j] >= place[i] else cells[j][own] for j in range(len(cols))]
                    runs = list(_runs(cells[i][own]))
                    yield _batch([i] * len(runs), [int(cells[i][own[a]]) for a, _ in runs], [
                        pickle.dumps([_packed(x[a:b]) if place[j] >= place[i] else x[a:b] for j, x in enumerate(sent)], 5) for a, b in runs])
        if entries:
            yield _batch(pairs, [0] * len(pairs), [pickle.dumps(_merged(x), 5) for x in sizes])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        i, held = int(group["col"].iloc[0]), map(pickle.loads, group["data"])
        if i < 0:
            a, b = names[-1 - i]
            size = np.zeros(widths[a] * widths[b], np.int64)
            for code, n in held:
                size[code] += n
            return pd.DataFrame([(-1 - i, *_between(size.reshape(widths[a], widths[b])[1:, 1:]))], columns=TAU_SUMS)
        held = list(held)
        own, out = _ranks(np.concatenate([_unpacked(x[i]) for x in held])), []
        for j in range(len(cols)):
            if j != i:
                whole = place[j] > place[i]
                other = np.concatenate([_unpacked(x[j]) if whole else x[j] for x in held])
                there = np.flatnonzero(other != (ABSENT if whole else 0))
                if len(there):
                    x, y = own[there], other[there]
                    y = _ranks(y) if whole else y.astype(np.int64)
                    # Rows of an interval of the other column may differ; only those of a single value are tied.
                    both = x * (int(y.max()) + 1) + y
                    out.append((number[min(i, j), max(i, j)], 0, *(_ties(x), 0)[::1 if i < j else -1],
                                _ties(both if whole else both[y & 1 == 0]), discordant(x, y)))
        return pd.DataFrame(out, columns=TAU_SUMS)

    dealt = spread(rows).mapInArrow(deal, "col int, cell int, data binary")
    sums = dealt.groupBy("col", "cell").applyInPandas(count, ", ".join(f"{c} bigint" for c in TAU_SUMS))
    parts = sums.groupBy("pair").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in TAU_SUMS[1:]]).filter("size > 0")
    total = "(size * (size - 1) / 2)"
    return parts.selectExpr("CAST(pair AS INT) AS pair", f"try_divide({total} - tx - ty + txy - 2 * discordant, "
                            f"sqrt({total} - tx) * sqrt({total} - ty)) AS correlation")


def _cuts(rows: DataFrame, kinds: Sequence[T.DataType]) -> tuple[list[np.ndarray], list[int]]:
    """Cuts of every column as keys, and the order in which columns compare whole values.

    Columns of few values come first, as their cells tell nearly all; then those whose values take most room.
    """
    n = range(len(kinds))
    head = sketched(rows.selectExpr(*[f"nanvl(v{i}, NULL) AS v{i}" for i in n]), [f"v{i}" for i in n], [], SKETCH).persist()
    try:
        sizes = head.selectExpr(*[f"n{i}" for i in n]).first()
        pieces = max(CELLS, max(n or 0 for n in sizes) // RANGE + 1)
        at = "array(" + ", ".join(f"{j / pieces!r}D" for j in range(1, pieces)) + ")"
        found = head.selectExpr(*[f"kll_sketch_get_quantile_double(IF(n{i} > 0, k{i}, NULL), {at}) AS e{i}" for i in n]).first()
    finally:
        head.unpersist()
    cuts = [np.unique(_keys(pa.array(found[i] or [], pa.float64()))) for i in n]
    return cuts, sorted(n, key=lambda i: (2 * len(cuts[i]) > pieces, isinstance(kinds[i], T.IntegralType), i))


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows; the last one may have fewer."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _batch(cols: list[int], cells: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), pa.array(cells, pa.int32()), pa.array(data, pa.binary())],
                                      ["col", "cell", "data"])


def _keys(column: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the values: NaN is the largest, 0 and -0 are one value; ABSENT for a missing one."""
    x = column.to_numpy(zero_copy_only=False) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    keys = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)
    if column.null_count:
        keys[column.is_null().to_numpy(zero_copy_only=False)] = ABSENT
    return keys


def _cells(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for a missing value, odd between cuts, even on one."""
    at = np.searchsorted(cuts, keys)
    cell = 2 * at + 1 + (np.append(cuts, ABSENT)[at] == keys)
    cell[keys == ABSENT] = 0
    return cell.astype(np.min_scalar_type(2 * len(cuts) + 2))


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often they come."""
    if int(codes.max()) < 4 * len(codes):
        n = np.bincount(codes)
        at = np.flatnonzero(n)
        n = n[at]
    else:
        at, n = np.unique(codes, return_counts=True)
    return at.astype(np.min_scalar_type(at[-1])), n.astype(np.min_scalar_type(n.max()))


def _merged(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, place = np.unique(np.concatenate([t[0] for t in tallies]), return_inverse=True)
    n = np.bincount(place.reshape(-1), np.concatenate([t[1] for t in tallies])).astype(np.int64)
    return at, n.astype(np.min_scalar_type(n.max()))


def _packed(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Keys in as few bytes as their distances need: the least one, the zero bits that all distances end with, and 1 + distance."""
    there = keys != ABSENT
    low = int(keys.min(where=there, initial=np.iinfo(np.int64).max))
    far = np.where(there, keys - np.int64(low), 0).view(np.uint64)      # may wrap, which the type below undoes
    every = int(np.bitwise_or.reduce(far))
    zeros = (every & -every).bit_length() - 1 if every else 0
    near = np.where(there, (far >> np.uint64(zeros)) + np.uint64(1), np.uint64(0))
    return low, zeros, near.astype(np.min_scalar_type((every >> zeros) + 1))


def _unpacked(packed: tuple[int, int, np.ndarray]) -> np.ndarray:
    low, zeros, near = packed
    keys = ((near.astype(np.uint64) - np.uint64(1)) << np.uint64(zeros)).view(np.int64) + np.int64(low)
    keys[near == 0] = ABSENT
    return keys


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _ties(values: np.ndarray) -> int:
    """Pairs of equal values."""
    if not len(values):
        return 0
    values = np.sort(values)
    n = np.diff(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])))
    return int((n * (n - 1) // 2).sum())


def _between(size: np.ndarray) -> tuple[int, int, int, int, int]:
    """Rows, ties per side and of both, and discordant pairs, as far as the sizes of cells tell. Every second cell is a single value."""
    tied = lambda n: int((n * (n - 1) // 2).sum())
    later = size.sum(axis=0) - np.cumsum(size, axis=0)                  # rows of the cells of higher x, per cell of y
    below = np.cumsum(later, axis=1) - later
    return int(size.sum()), tied(size.sum(axis=1)[1::2]), tied(size.sum(axis=0)[1::2]), tied(size[1::2, 1::2]), int((size * below).sum())


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place (exclusive) of every run of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of rows whose x rises while y falls, bit by bit of y; both are ranks or other small whole numbers.

    Two values first differ, from the top, in one bit. Rows that agree above it form a group; in the order of x, a row whose
    bit is 0 falls behind the rows before it whose bit is 1. At equal x those come after it.
    """
    high, wide, found = int(y.max()).bit_length(), int(x.max()).bit_length(), 0
    sizes = np.bincount(y, minlength=1 << high)
    for bit in range(high):
        kind = np.int32 if high - bit + wide < 32 else np.int64         # short keys are sorted faster
        key = (y >> bit + 1).astype(kind)
        key <<= wide
        key |= x.astype(kind)
        key <<= 1
        key |= ((y >> bit) & 1).astype(kind)
        key.sort()
        one = np.cumsum(key & 1, dtype=np.int64)
        zeros, ones = sizes[::2], sizes[1::2]       # per group
        sizes = zeros + ones
        # Of the rows whose bit is 1 before those whose bit is 0, the ones of the groups before do not count.
        m = int(one[-1])
        found += int(one.sum()) - m * (m + 1) // 2 - int((zeros * (np.cumsum(ones) - ones)).sum())
    return found
