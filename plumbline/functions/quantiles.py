"""Exact quantiles and running counts without gathering a column in one task.

A quantile sketch gives, for every wanted quantile, an interval that holds it. Every value outside
the intervals is snapped to the nearest interval edge: this map keeps the order, so the wanted
order statistics do not change, but only few distinct values are left to count and rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import COUNT, attach, materialize, quoted, same_keys

PARTIALS = 512            # partial sketches per group, merged in a second step
SLICES = 64               # ranking tasks per interval
CELLS = 512               # cells of a column of counted rows


def rank_error(k: int) -> float:
    """Four times the published rank error of the sketch with parameter k."""
    return 4 * 2.446 / k ** 0.9433


def sketched(df: DataFrame, columns: Sequence[str], keys: Sequence[str], k: int) -> DataFrame:
    """One row per group: count, min, max and sketch of every column, merged in two steps."""
    by = ", ".join(map(quoted, keys))
    comma = f"{by}, " if by else ""
    n = range(len(columns))
    values = ", ".join(f"CAST({quoted(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(columns))
    first = ", ".join(f"count(v{i}) AS n{i}, min(v{i}) AS lo{i}, max(v{i}) AS hi{i}, "
                      f"kll_sketch_agg_double(v{i}, {k}) AS k{i}" for i in n)
    second = ", ".join(f"sum(n{i}) AS n{i}, min(lo{i}) AS lo{i}, max(hi{i}) AS hi{i}, "
                       f"kll_merge_agg_double(k{i}) AS k{i}" for i in n)
    return df.sparkSession.sql(f"""
        SELECT {comma}{second} FROM (
          SELECT {comma}__salt, {first}
          FROM (SELECT {comma}spark_partition_id() % {PARTIALS} AS __salt, {values} FROM {{rows}})
          GROUP BY {comma}__salt)
        {f'GROUP BY {by}' if by else ''}""", rows=df)


def _intervals(i: int, probs: Sequence[float], delta: float, whole: bool = False) -> str:
    """SQL array [lo, hi, lo, hi, ..] with one interval per quantile: twice the sketch's error to either side.

    That covers two ranks more than the error where n * delta > 2; of fewer values the whole range is the interval.
    """
    def edge(p: float, sign: int) -> str:
        end, rank = f"lo{i}" if sign < 0 else f"hi{i}", p + sign * 2 * delta
        if whole or not 0 < rank < 1:
            return end
        return f"IF(n{i} * {delta!r}D > 2, coalesce(kll_sketch_get_quantile_double(k{i}, {rank:.17g}D), {end}), {end})"
    return "array(" + ", ".join(f"{edge(p, -1)}, {edge(p, 1)}" for p in probs) + ")"


def _snap(v: str, edges: str, n: int) -> tuple[str, str]:
    """SQL of the order-preserving snap of v to the intervals, and of the slice v falls into.

    Slices (part div SLICES) are odd inside an interval and even outside, where values collapse.
    """
    value, part = [], []
    for j in range(n):
        lo, hi = f"{edges}[{2 * j}]", f"{edges}[{2 * j + 1}]"
        inner = f"coalesce(CAST(floor(({v} - {lo}) / nullif({hi} - {lo}, 0D) * {SLICES - 1}) AS INT), 0)"
        value.append(f"WHEN {v} < {lo} THEN {lo} WHEN {v} <= {hi} THEN {v}")
        part.append(f"WHEN {v} < {lo} THEN {2 * j * SLICES} WHEN {v} <= {hi} THEN {(2 * j + 1) * SLICES} + {inner}")
    return (f"CASE {' '.join(value)} ELSE {edges}[{2 * n - 1}] END",
            f"CASE {' '.join(part)} ELSE {2 * n * SLICES} END")


def grouped_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                      keys: Sequence[str], k: int = 1000) -> DataFrame:
    """Exact linear-interpolated quantiles: keys + one ARRAY<DOUBLE> per column (NULLs ignored).

    Two scans; between them only sketches and snapped counts are shuffled, so a group of any size is never held by one
    task. Every wanted position is looked up: should one lie outside its interval, the intervals become whole ranges.
    """
    keys, probs, spark = list(keys), sorted(probs), df.sparkSession
    by = ", ".join(map(quoted, keys))
    n = range(len(columns))
    delta = rank_error(k)
    head = sketched(df, columns, keys, k)
    cells = ", ".join(f"struct({i} AS __c, v{i} AS __v, __e.e{i} AS e)" for i in n)
    value, part = _snap("__v", "e", len(probs))
    for whole in (False, True):
        fitted = spark.sql(f"SELECT {by}, " + ", ".join(f"{_intervals(i, probs, delta, whole)} AS e{i}" for i in n) + " FROM {s}", s=head)
        rows = attach(df.selectExpr(*map(quoted, keys), *[f"CAST({quoted(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(columns)]),
                      fitted, keys, "__e")
        counts = spark.sql(f"""
            SELECT {by}, __c, __part, __v, count(*) AS __n FROM (
              SELECT {by}, __c, {value} AS __v, {part} AS __part
              FROM (SELECT {by}, inline(array({cells})) FROM {{rows}}) WHERE __v IS NOT NULL)
            GROUP BY {by}, __c, __part, __v""", rows=rows)
        # Written once: the slices' totals and their values both come from the counts.
        ranked = _ranked(materialize(counts), [*keys, "__c"], probs).persist()
        places = " OR ".join(f"(__below <= {x} AND {x} < __below + __n)" for p in probs
                             for x in (f"floor((__size - 1) * {p:.17g}D)", f"least(floor((__size - 1) * {p:.17g}D) + 1, __size - 1)"))
        if whole or ranked.filter(f"(__part div {SLICES}) % 2 = 0 AND ({places})").isEmpty():
            break
        ranked.unpersist()
    outs = []
    for i, c in enumerate(columns):
        parts = []
        for p in probs:
            h, low = f"((__size - 1) * {p:.17g}D)", f"floor((__size - 1) * {p:.17g}D)"
            high = f"least({low} + 1, __size - 1)"
            a, b = (f"max(__v) FILTER (WHERE __c = {i} AND __below <= {x} AND {x} < __below + __n)" for x in (low, high))
            parts.append(f"{a} + (max({h} - {low}) FILTER (WHERE __c = {i})) * ({b} - {a})")
        outs.append(f"array({', '.join(parts)}) AS {quoted(c)}")
    return spark.sql(f"SELECT {by}, {', '.join(outs)} FROM {{ranked}} GROUP BY {by}", ranked=ranked)


def _ranked(counts: DataFrame, group: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """Rows (group, __v, __n, __below, __size) of the slices that hold a wanted quantile.

    `__below` is the number of values smaller than __v in its group, `__size` the size of the group.
    """
    by = ", ".join(map(quoted, group))
    totals = counts.sparkSession.sql(f"""
        SELECT {by}, __part, t, sum(t) OVER (PARTITION BY {by}) AS __size,
          coalesce(sum(t) OVER (PARTITION BY {by} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before
        FROM (SELECT {by}, __part, sum(__n) AS t FROM {{counts}} GROUP BY {by}, __part)""", counts=counts)
    hit = " OR ".join(f"(__before <= floor((__size - 1) * {p:.17g}D) + 1 AND floor((__size - 1) * {p:.17g}D) < __before + t)"
                      for p in wanted)
    picked = same_keys(counts, totals.filter(hit).drop("t"), [*group, "__part"])
    return picked.selectExpr(
        *map(quoted, group), "__part", "__v", "__n", "__size",
        f"__before + sum(__n) OVER (PARTITION BY {by}, __part ORDER BY __v ROWS UNBOUNDED PRECEDING) - __n AS __below")


@dataclass
class CountedQuantiles:
    """Of counted rows, per group and column number c: means (keys, c, n, mean), and values (keys, c, q, value).

    sizes: the number of values per column, where `probs` was a function of it.
    """

    means: DataFrame
    values: DataFrame
    sizes: dict[int, int] = field(default_factory=dict)


def counted_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] | Callable[[int], Sequence[float]],
                      keys: Sequence[str] = ()) -> CountedQuantiles:
    """Exact linear-interpolated quantiles of rows that stand for COUNT equal ones; only without keys may `probs` be a function.

    Counts per cell of a column tell which cells hold the wanted positions; only the values of these are counted one by
    one. Cells are cut by a sketch of the distinct rows: any cut gives the same result.
    """
    keys, columns = list(keys), list(columns)
    by = "".join(f"{quoted(k)}, " for k in keys)
    n = range(len(columns))
    values = df.selectExpr(*map(quoted, keys), f"{COUNT} AS w", *[f"CAST({quoted(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(columns)])
    at = "array(" + ", ".join(f"{j / CELLS!r}D" for j in range(1, CELLS)) + ")"
    cuts = sketched(values, [f"v{i}" for i in n], [], 4000).selectExpr(
        *[f"kll_sketch_get_quantile_double(IF(n{i} > 0, k{i}, NULL), {at}) AS e{i}" for i in n]).first()
    splits = [sorted({x for x in cuts[i] or [] if math.isfinite(x)}) for i in n]
    celled = Bucketizer(splitsArray=[[-math.inf, *(s or [0.0]), math.inf] for s in splits], inputCols=[f"v{i}" for i in n],
                        outputCols=[f"b{i}" for i in n], handleInvalid="keep").transform(values)
    cells = ", ".join(f"struct({i} AS c, v{i} AS v, CAST(b{i} AS INT) AS b)" for i in n)
    flat = celled.selectExpr(*map(quoted, keys), "w", f"inline(array({cells}))").filter("v IS NOT NULL")
    hist = materialize(flat.groupBy(*keys, "c", "b").agg(F.sum("w").alias("n"), F.sum(F.expr("w * v")).alias("s")))
    spark = df.sparkSession
    sizes: dict[int, int] = {}
    if callable(probs):
        sizes = {r["c"]: int(r["n"]) for r in hist.groupBy("c").agg(F.sum("n").alias("n")).collect()}
        wanted = [sorted(probs(sizes[i])) if i in sizes else [] for i in n]
    else:
        wanted = [sorted(probs)] * len(columns)
    grid = "array(" + ", ".join("CAST(array(" + ", ".join(f"{p!r}D" for p in w) + ") AS ARRAY<DOUBLE>)" for w in wanted) + ")[c]"
    low = "CAST(floor(h) AS BIGINT)"
    asks = (f"flatten(transform(transform({grid}, p -> (size - 1) * p), (h, q) -> array("
            f"struct(q AS q, 0 AS side, {low} AS pos, h - floor(h) AS f), struct(q AS q, 1 AS side, least({low} + 1, size - 1) AS pos, h - floor(h) AS f))))")
    placed = spark.sql(f"""
        SELECT *, filter({asks}, a -> a.pos >= before AND a.pos < before + n) AS asked FROM (
          SELECT {by}c, b, n, CAST(sum(n) OVER (PARTITION BY {by}c) AS BIGINT) AS size,
            CAST(sum(n) OVER (PARTITION BY {by}c ORDER BY b ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS before FROM {{h}})""", h=hist)
    # At most two cells per wanted quantile, written so that Spark knows how few they are.
    hit = materialize(placed.filter("size(asked) > 0").select(*keys, "c", "b", "before", "asked"))
    near = same_keys(flat, hit.select(*keys, "c", "b"), [*keys, "c", "b"]).groupBy(*keys, "c", "b", "v").agg(F.sum("w").alias("n"))
    ranked = same_keys(near, hit, [*keys, "c", "b"]).selectExpr(
        *map(quoted, keys), "c", "v", "n", "asked",
        f"before + sum(n) OVER (PARTITION BY {by}c, b ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
    found = ranked.selectExpr(*map(quoted, keys), "c", "v", "inline(filter(asked, a -> a.pos < upto AND a.pos >= upto - n))")
    return CountedQuantiles(
        spark.sql(f"SELECT {by}c, sum(n) AS n, sum(s) / sum(n) AS mean FROM {{h}} GROUP BY {by}c", h=hist),
        spark.sql(f"""SELECT {by}c, q, a + f * (b - a) AS value FROM (SELECT {by}c, q, max(f) AS f, max(IF(side = 0, v, NULL)) AS a,
                      max(IF(side = 1, v, NULL)) AS b FROM {{r}} GROUP BY {by}c, q)""", r=found), sizes)


def fit_counted(df: DataFrame, columns: Sequence[str], *wanted: Callable[[int], Sequence[float]]) -> list[dict[str, list[float]]]:
    """Exact quantiles of whole columns of counted rows, once per function of a column's value count; all are looked up together."""
    columns = list(columns)
    if not columns:
        return [{} for _ in wanted]
    together = lambda n: sorted({p for w in wanted for p in w(n)})
    got = counted_quantiles(df, columns, together)
    found: dict[int, dict[int, float]] = {}
    for r in got.values.collect():
        found.setdefault(r["c"], {})[r["q"]] = r["value"]
    at = {i: dict(zip(together(got.sizes[i]), (found[i][q] for q in sorted(found[i])))) for i in found}
    return [{c: [at[i][p] for p in sorted(w(got.sizes[i]))] for i, c in enumerate(columns) if i in at} for w in wanted]


def fit_quantiles(df: DataFrame, columns: Sequence[str],
                  probs: Sequence[float] | Callable[[int], Sequence[float]],
                  k: int | None = None) -> dict[str, list[float]]:
    """Exact quantiles of whole columns as plain numbers; columns without values are left out.

    Any number of quantiles per column; `probs` may depend on the column's value count. The driver
    receives interval edges and answers only: a few numbers per wanted quantile. Counted rows (with COUNT) weigh as many.
    """
    columns = list(columns)
    if not columns:
        return {}
    if COUNT in df.columns:
        found: dict[str, dict[int, float]] = {}
        for r in counted_quantiles(df, columns, probs).values.collect():
            found.setdefault(columns[r["c"]], {})[r["q"]] = r["value"]
        return {c: [found[c][q] for q in sorted(found[c])] for c in columns if c in found}
    k = k or (16000 if callable(probs) or len(probs) > 4 else 2000)
    delta = rank_error(k)
    wanted_of = probs if callable(probs) else (lambda n: list(probs))
    grid = [] if callable(probs) else sorted(probs)
    head = sketched(df, columns, [], k)
    if callable(probs):
        head = head.persist()
    try:
        edge_cols = lambda cols, want: [f"{_intervals(i, want[c], delta)} AS e{i}" for i, c in cols]
        both = [(i, c) for i, c in enumerate(columns)]
        sizes = [x for i, _ in both for x in (f"n{i}", f"lo{i}", f"hi{i}")]
        if callable(probs):
            ns = head.selectExpr(*sizes).first()
            wanted = {c: sorted(wanted_of(int(ns[f"n{i}"]))) for i, c in both if ns[f"n{i}"]}
            live = [(i, c) for i, c in both if c in wanted]
            if not live:
                return {}
            edge_row = head.selectExpr(*edge_cols(live, wanted)).first()
        else:
            ns = edge_row = head.selectExpr(*sizes, *edge_cols(both, {c: grid for c in columns})).first()
            wanted = {c: grid for i, c in both if ns[f"n{i}"]}
            live = [(i, c) for i, c in both if c in wanted]
    finally:
        head.unpersist()
    if not live:
        return {}
    names = [c for _, c in live]
    size = {c: int(ns[f"n{i}"]) for i, c in live}
    # Odd cells are kept value by value, even cells collapse to their left edge. A wanted position that turns up in an
    # even cell was missed by its interval: that cell is kept too, and the values are counted again.
    kept = {c: [list(x) for x in zip(edge_row[f"e{i}"][::2], edge_row[f"e{i}"][1::2])] for i, c in live}
    ends = {c: (ns[f"lo{i}"], ns[f"hi{i}"]) for i, c in live}
    while True:
        edges = {c: _cells(kept[c]) for c in names}
        got, missed = _look_up(df, names, edges, wanted, size)
        if not missed:
            break
        for c, cell in missed:
            around = [ends[c][0], *edges[c], ends[c][1]]
            kept[c].append([around[cell], around[cell + 1]])
    out = {}
    for j, c in enumerate(names):
        vals = []
        for q, p in enumerate(wanted[c]):
            h = (size[c] - 1) * p
            a, b = got[(j, q, 0)], got[(j, q, 1)]
            vals.append(a + (h - math.floor(h)) * (b - a))
        out[c] = vals
    return out


def _look_up(df: DataFrame, names: Sequence[str], edges: dict[str, list[float]], wanted: dict[str, list[float]],
             size: dict[str, int]) -> tuple[dict[tuple[int, int, int], float], set[tuple[str, int]]]:
    """Values at the wanted positions, (column, quantile, lower or upper) -> value; and the collapsed cells some fell into."""
    spark = df.sparkSession
    cut = Bucketizer(splitsArray=[[-math.inf, *edges[c], math.inf] for c in names],
                     inputCols=[f"v{j}" for j in range(len(names))],
                     outputCols=[f"b{j}" for j in range(len(names))], handleInvalid="keep")
    rows = cut.transform(df.selectExpr(*[f"CAST({quoted(c)} AS DOUBLE) AS v{j}" for j, c in enumerate(names)]))
    rows = rows.selectExpr(*[f"v{j}" for j in range(len(names))], *[f"CAST(b{j} AS INT) AS b{j}" for j in range(len(names))])
    # Expressions over all columns at once would outgrow the compiled code, so rows are first turned
    # into (attr, value) and the edges looked up by attr.
    grid_sql = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in edges[c]) + ")" for c in names) + ")"
    melted = rows.selectExpr("inline(array(" + ", ".join(f"struct({j} AS attr, v{j} AS v, b{j} AS b)" for j in range(len(names))) + "))")
    lo, hi = f"{grid_sql}[attr][b - 1]", f"{grid_sql}[attr][b]"
    slice_sql = f"coalesce(CAST(floor((v - {lo}) / nullif({hi} - {lo}, 0D) * {SLICES - 1}) AS INT), 0)"
    counts = spark.sql(f"""
        SELECT attr, part, v, count(*) AS n FROM (
          SELECT attr, b * {SLICES} + IF(b % 2 = 1, {slice_sql}, 0) AS part,
            IF(b % 2 = 1, v, {grid_sql}[attr][greatest(b - 1, 0)]) AS v
          FROM {{rows}} WHERE v IS NOT NULL)
        GROUP BY attr, part, v""", rows=melted)
    targets = []
    for j, c in enumerate(names):
        for q, p in enumerate(wanted[c]):
            low = math.floor((size[c] - 1) * p)
            targets += [(j, q, 0, low), (j, q, 1, min(low + 1, size[c] - 1))]
    places = spark.createDataFrame(targets, "attr int, q int, side int, pos bigint")
    totals = spark.sql("""
        SELECT attr, part, t, coalesce(sum(t) OVER (PARTITION BY attr ORDER BY part
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT attr, part, sum(n) AS t FROM {c} GROUP BY attr, part)""", c=counts)
    # Only the slices that hold a wanted position are ranked; there are at most as many as positions.
    asked = (totals.join(F.broadcast(places), ["attr"]).filter("before <= pos AND pos < before + t")
             .groupBy("attr", "part", "before").agg(F.collect_list(F.struct("q", "side", "pos")).alias("asked")))
    ranked = counts.join(asked, ["attr", "part"]).selectExpr(
        "attr", "part", "v", "n", "asked",
        "before + sum(n) OVER (PARTITION BY attr, part ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
    found = ranked.selectExpr("attr", "part", "v", "inline(filter(asked, a -> a.pos < upto AND a.pos >= upto - n))").collect()
    got = {(r["attr"], r["q"], r["side"]): r["v"] for r in found}
    return got, {(names[r["attr"]], r["part"] // SLICES) for r in found if r["part"] // SLICES % 2 == 0}


def _cells(pairs: Sequence[Sequence[float]]) -> list[float]:
    """Merge overlapping intervals; returns lo, just-above-hi, lo, just-above-hi, .."""
    pairs = sorted(list(x) for x in pairs)
    merged: list[list[float]] = []
    for lo, hi in pairs:
        if merged and lo <= math.nextafter(merged[-1][1], math.inf):
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [x for lo, hi in merged for x in (lo, math.nextafter(hi, math.inf))]


def running_counts(counts: DataFrame, group: Sequence[str], value: str, n: str, extra: Sequence[str] = ()) -> DataFrame:
    """Add `before` (sum of n over smaller values of the group) and `size` to a table of counts.

    `counts` has one row per (group, value); with `extra`, these columns are summed in the same way into before_<name> and
    size_<name>. Rows are dealt by ranges of (group, value) and written once; sums run inside a range and are shifted by
    the totals of the group's ranges before. Spark sizes the ranges, so they hold no more rows on more data.
    """
    group, spark = list(group), counts.sparkSession
    by = ", ".join(map(quoted, group))
    dealt = materialize(counts.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group], F.col(value).asc_nulls_first())
                        .withColumn("__part", F.spark_partition_id()))
    sums = [n, *extra]
    alias = {c: "" if c == n else f"_{c}" for c in sums}
    totals = ", ".join(f"sum({c}) AS t_{c}" for c in sums)
    shifts = ", ".join(
        f"sum(t_{c}) OVER (PARTITION BY {by}) AS size{alias[c]}, coalesce(sum(t_{c}) OVER (PARTITION BY {by} ORDER BY __part "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o_{c}" for c in sums)
    shift = spark.sql(f"SELECT {by}, __part, {shifts} FROM (SELECT {by}, __part, {totals} FROM {{c}} GROUP BY {by}, __part)", c=dealt)
    joined = same_keys(dealt, shift, [*group, "__part"])
    return joined.selectExpr(
        *map(quoted, counts.columns), *[f"size{alias[c]}" for c in sums],
        *[f"o_{c} + sum({c}) OVER (PARTITION BY {by}, __part ORDER BY {value} ROWS UNBOUNDED PRECEDING) - {c} AS before{alias[c]}"
          for c in sums])
