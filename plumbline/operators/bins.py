"""Equal-frequency bins of numeric columns and the quality of every bin."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..core import COUNT, attach, clean, count_rows, materialize, numeric_columns, quoted, same_keys
from ..functions.quantiles import counted_quantiles, fit_quantiles
from .metrics import MIN_FOR_KURTOSIS, MIN_FOR_OUTLIERS, MIN_FOR_SKEW

# The metrics that need no configuration, as kept for every bin.
BIN_METRICS = ("completeness", "outlier_rate", "duplicate_rate", "distribution_skewness",
               "distribution_kurtosis", "overall_quality")


def shares(n_bins: int) -> Callable[[int], list[float]]:
    """The quantiles that bound the bins of a column, by its number of values."""
    return lambda n: [i / min(n_bins, n) for i in range(min(n_bins, n) + 1)]


def fit_boundaries(df: DataFrame, columns: Sequence[str] | None = None, n_bins: int = 100,
                   found: dict[str, list[float]] | None = None) -> dict[str, list[float]]:
    """Distinct quantile boundaries per column, n + 1 at most.

    A constant column gives one closed bin [v, v]; a column without values is left out. Counted rows (with COUNT) weigh as many.
    `found` brings the quantiles (`shares`) along.
    """
    cols = [c for c in numeric_columns(df, columns) if c != COUNT]
    if found is None:
        found = fit_quantiles(clean(df.select(*cols, *([COUNT] if COUNT in df.columns else []))), cols, shares(n_bins))
    out = {}
    for c in cols:
        if c in found:
            distinct = sorted(set(found[c]))
            out[c] = distinct if len(distinct) > 1 else distinct * 2
    return out


def boundaries_frame(spark, boundaries: dict[str, list[float]]) -> DataFrame:
    rows = [(a, i, float(b)) for a, bs in boundaries.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "attr string, position int, boundary double")


def assign_bins(df: DataFrame, boundaries: dict[str, Sequence[float]], null_bin: int | str | None = 0,
                prefix: str = "bin_") -> DataFrame:
    """Add one INT column per attribute: the number of inner boundaries <= value.

    Values below or above all boundaries fall into the first or last bin, NULL into `null_bin`
    (None keeps it NULL, 'own' adds a bin after the last one). An attribute the table lacks gets bin 0.
    """
    have = {a: bs for a, bs in boundaries.items() if a in df.columns}
    names = list(have)
    x = {a: f"__x{i}" for i, a in enumerate(names)}
    kept = [quoted(c) for c in df.columns]
    rows = df.selectExpr(*kept, *[f"nanvl(CAST({quoted(a)} AS DOUBLE), NULL) AS {x[a]}" for a in names])
    cut = [a for a in names if len(have[a]) > 2]
    if cut:
        rows = Bucketizer(splitsArray=[[-math.inf, *map(float, have[a][1:-1]), math.inf] for a in cut],
                          inputCols=[x[a] for a in cut], outputCols=[f"__b{x[a]}" for a in cut],
                          handleInvalid="keep").transform(rows)
    outs = []
    for a in boundaries:
        if a not in have:
            value = "0"
        else:
            value = f"CAST(__b{x[a]} AS INT)" if a in cut else f"IF({x[a]} IS NULL, NULL, 0)"
            if null_bin is not None:
                value = f"coalesce({value}, {len(have[a]) - 1 if null_bin == 'own' else null_bin})"
        outs.append(f"{value} AS {quoted(prefix + a)}")
    return rows.selectExpr(*kept, *outs)


def by_bin(binned: DataFrame, attributes: Sequence[str], columns: Sequence[str], prefix: str = "bin_") -> DataFrame:
    """(attr, bin_id, columns): every row once per attribute with a bin."""
    cells = ", ".join(f"struct('{a}' AS attr, {quoted(prefix + a)} AS bin_id)" for a in attributes)
    return binned.selectExpr(f"inline(array({cells}))", *map(quoted, columns)).filter("bin_id IS NOT NULL")


def row_groups(counted: DataFrame, attributes: Sequence[str], columns: Sequence[str], prefix: str = "bin_") -> DataFrame:
    """(attr, bin_id, n, distinct_rows, filled) of counted rows with bins: equal rows share their bins, so rows are compared once."""
    bins = [prefix + a for a in attributes]
    filled = " + ".join(f"CAST({quoted(c)} IS NOT NULL AS INT)" for c in columns)
    rows = counted
    if set(attributes) - set(columns) or set(counted.columns) - {*columns, *bins, COUNT}:
        rows = rows.groupBy(*[F.col(quoted(c)) for c in dict.fromkeys([*columns, *bins])]).agg(F.sum(COUNT).alias(COUNT))
    rows = rows.withColumn("__filled", F.expr(f"({filled}) * {COUNT}"))
    return by_bin(rows, attributes, [COUNT, "__filled"], prefix).groupBy("attr", "bin_id").agg(
        F.sum(COUNT).alias("n"), F.count(F.lit(1)).alias("distinct_rows"), F.sum("__filled").alias("filled"))


def bin_quality(df: DataFrame, boundaries: dict[str, Sequence[float]], columns: Sequence[str] | None = None,
                configs: dict[str, dict] | None = None, catalog: Catalog | None = None, counted: DataFrame | None = None) -> DataFrame:
    """bins(attr, bin_id, lower, upper, n, quality MAP): exact metrics of every non-empty bin.

    Equal rows are counted first; `counted` or a `df` with COUNT brings them along. `configs` adds metrics of the catalog
    by name, with their configuration, over all columns of `df`, whose rows must not be counted then.
    """
    cols = list(columns or (c for c in df.columns if c != COUNT))
    numeric = numeric_columns(df, cols)
    attrs = list(boundaries)
    counted = counted or count_rows(df, list(dict.fromkeys([*cols, *[a for a in attrs if a in df.columns]])))
    binned = assign_bins(counted, boundaries, null_bin=None)
    keys = ["attr", "bin_id"]
    rows = by_bin(binned, attrs, [*numeric, COUNT])
    m = range(len(numeric))
    both = row_groups(binned, attrs, cols)
    if numeric:
        got = counted_quantiles(rows, numeric, (0.25, 0.75), keys)
        quarts = got.values.groupBy(*keys, "c").agg(*[F.expr(f"max(IF(q = {q}, value, NULL))").alias(f"q{q}") for q in (0, 1)])
        per = same_keys(got.means, quarts, [*keys, "c"]).groupBy(*keys).agg(*[F.expr(
            f"max(IF(c = {i}, struct(q0 - 1.5D * (q1 - q0) AS lo, q1 + 1.5D * (q1 - q0) AS hi, mean), NULL))").alias(f"f{i}") for i in m])
        aggs = []
        for i, c in enumerate(map(quoted, numeric)):
            # Powers of the distance to the bin's own mean: no digits are lost in narrow bins.
            x, d, f = f"CAST({c} AS DOUBLE)", f"d{i}", f"__s.f{i}"
            aggs += [f"sum(IF({c} IS NOT NULL, {COUNT}, 0)) AS n{i}", f"coalesce(sum(IF({x} < {f}.lo OR {x} > {f}.hi, {COUNT}, 0)), 0) AS o{i}",
                     f"min({x}) AS l{i}", f"max({x}) AS h{i}", f"sum({COUNT} * {d} * {d}) AS p{i}",
                     f"sum({COUNT} * {d} * {d} * {d}) AS t{i}", f"sum({COUNT} * {d} * {d} * {d} * {d}) AS u{i}"]
        # One row per bin, written so that Spark knows its size and sends it to the rows instead of shuffling them.
        near = attach(rows, materialize(per), keys).selectExpr(
            "*", *[f"CAST({quoted(c)} AS DOUBLE) - __s.f{i}.mean AS d{i}" for i, c in enumerate(numeric)])
        cells = near.groupBy(*keys).agg(*map(F.expr, aggs)).selectExpr(
            *keys, *[x for i in m for x in (f"n{i}", f"o{i}",
                                            f"IF(l{i} < h{i}, abs(try_divide(t{i} / n{i}, pow(p{i} / n{i}, 1.5D))), NULL) AS s{i}",
                                            f"IF(l{i} < h{i}, abs(try_divide(n{i} * u{i}, p{i} * p{i}) - 3D), NULL) AS k{i}")])
        both = same_keys(both, cells, keys)
    mean = lambda s, least: ("coalesce(try_divide(" + " + ".join(["0D", *[f"IF(n{i} >= {least}, coalesce({s}{i}, 0D), 0D)" for i in m]]) + ", "
                             + " + ".join(["0", *[f"CAST(n{i} >= {least} AND {s}{i} IS NOT NULL AS INT)" for i in m]]) + "), 0D)")
    outside = " + ".join(["0", *[f"IF(n{i} >= {MIN_FOR_OUTLIERS}, o{i}, 0)" for i in m]])
    scored = both.selectExpr(
        *keys, "n", f"CAST(filled AS DOUBLE) / (n * {len(cols)}) AS completeness",
        f"CAST({outside} AS DOUBLE) / (n * {max(1, len(numeric))}) AS outlier_rate",
        "CAST(n - distinct_rows AS DOUBLE) / n AS duplicate_rate",
        f"{mean('s', MIN_FOR_SKEW)} AS distribution_skewness", f"{mean('k', MIN_FOR_KURTOSIS)} AS distribution_kurtosis")
    scored = scored.selectExpr("*", "0.5D * completeness + 0.5D * (1 - outlier_rate) AS overall_quality")
    if configs:
        from .binned import bin_metrics
        scored = scored.join(bin_metrics(clean(df), boundaries, configs, catalog), keys, "left")
    return with_bounds(scored, boundaries, [*BIN_METRICS, *(configs or {})])


def bin_means(df: DataFrame, boundaries: dict[str, Sequence[float]], metrics: Sequence[str]) -> DataFrame:
    """bins with the mean of row-level metric columns as quality."""
    rows = by_bin(assign_bins(df, boundaries, null_bin=None), list(boundaries), metrics)
    means = rows.groupBy("attr", "bin_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return with_bounds(means, boundaries, metrics)


def with_bounds(scored: DataFrame, boundaries: dict[str, Sequence[float]], metrics: Sequence[str]) -> DataFrame:
    """Add lower and upper from the boundaries and pack the metric columns into a map."""
    grids = "map(" + ", ".join(f"'{a}', array({', '.join(f'{float(b)!r}D' for b in bs)})" for a, bs in boundaries.items()) + ")"
    packed = "map(" + ", ".join(f"'{m}', CAST({quoted(m)} AS DOUBLE)" for m in metrics) + ")"
    return scored.selectExpr("attr", "bin_id", f"{grids}[attr][bin_id] AS lower", f"{grids}[attr][bin_id + 1] AS upper",
                             "n", f"{packed} AS quality")


def fit_bins(df: DataFrame, columns: Sequence[str] | None = None, n_bins: int = 20,
             metric_columns: Sequence[str] | None = None, configs: dict[str, dict] | None = None,
             catalog: Catalog | None = None) -> DataFrame:
    """Boundaries and exact bin quality in one go, kept as a small local table.

    It has at most n_bins rows per attribute, so later steps read it instead of measuring again.
    """
    wanted = list(dict.fromkeys([*(metric_columns or df.columns), *(columns or [])]))
    counted = count_rows(df, wanted)
    boundaries = fit_boundaries(counted, columns, n_bins)
    bins = bin_quality(df if configs else counted, boundaries, metric_columns, configs, catalog, counted)
    return df.sparkSession.createDataFrame(bins.collect(), bins.schema)


def bin_summary(bins: DataFrame) -> DataFrame:
    return bins.groupBy("attr").agg(F.count(F.lit(1)).alias("n_bins"), F.min("n").alias("min_size"),
                                    F.max("n").alias("max_size"), F.avg("n").alias("avg_size"))


def unpivot_quality(bins: DataFrame) -> DataFrame:
    """(attr, bin_id, n, metric, value)."""
    return bins.select("attr", "bin_id", "n", F.explode("quality").alias("metric", "value"))


def final_boundaries(bins: DataFrame) -> DataFrame:
    """(attr, boundaries): all lower bounds and the last upper one; gaps close into the left bin."""
    return bins.groupBy("attr").agg(F.expr("concat(array_sort(collect_list(lower)), array(max(upper))) AS boundaries"))


def boundaries_of(bins: DataFrame) -> dict[str, list[float]]:
    """The boundaries as plain numbers: at most a hundred or so per attribute."""
    return {r["attr"]: list(r["boundaries"]) for r in final_boundaries(bins).collect()}
