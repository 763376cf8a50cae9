"""Evaluation runs: accuracy, discretization variants, budgets, settings."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..sources.tables import first_rows
from .discretize import assess, discretize, discretize_adaptive, discretization_frame
from .index import IndexParams, Prepared, QualityIndex, fit_index, prepare

# The seven settings that are compared, as changes to one baseline.
BASELINE = {"budget": 50, "n_bins": 100, "trees": 50, "depth": 15, "merging": "adaptive", "merge_threshold": 0.01}
GRID = {"baseline": {}, "more_trees": {"trees": 100}, "deeper_trees": {"depth": 25}, "more_bins": {"budget": 100, "n_bins": 150},
        "finer_initial": {"n_bins": 200}, "stricter_merging": {"merge_threshold": 0.005},
        "combined": {"budget": 100, "n_bins": 150, "trees": 100, "depth": 20, "merge_threshold": 0.005}}

RUN_SCHEMA = "run string, n_features int, n_bins int, utilization double, test_r2 double, test_mse double, test_mae double"


def _row(name: str, index) -> tuple:
    overall = next((r for r in index.fit_metrics if r[0] == "test" and r[1] == "overall"), (None,) * 5)
    bins = sum(map(len, index.quality.values()))
    return (name, len(index.features), bins, bins / index.params.budget, overall[3], overall[2], overall[4])


def run_settings(df: DataFrame, runs: dict[str, IndexParams], features: Sequence[str] | None = None, key: Sequence[str] = (),
                 prepared: Prepared | None = None) -> DataFrame:
    """One fit per named setting. Settings with the same initial bins and targets share one merge history, and what else is equal."""
    shared: dict[tuple, Prepared] = {}
    fits: dict = {}
    rows: dict[str, tuple] = {}
    for params in runs.values():
        at = (params.n_bins, params.target, params.size_weight)
        if at not in shared:
            # What was prepared before belongs to the first setting's initial bins.
            shared[at] = prepared if prepared and not shared else prepare(df, features, params)
    # Most trees first: settings that grow fewer ones of the same kind take the first of them.
    for name, params in sorted(runs.items(), key=lambda r: -r[1].trees):
        rows[name] = _row(name, fit_index(df, features, params, key, shared[params.n_bins, params.target, params.size_weight], fits))
    return df.sparkSession.createDataFrame([rows[name] for name in runs], RUN_SCHEMA)


def budget_sweep(df: DataFrame, budgets: Sequence[int], params: IndexParams, features=None, key=(), prepared=None) -> DataFrame:
    return run_settings(df, {str(b): replace(params, budget=b) for b in budgets}, features, key, prepared)


def ablation(df: DataFrame, params: IndexParams, features=None, key=(), prepared=None) -> DataFrame:
    """The full index against versions without merging, with half the trees, or with one score only."""
    return run_settings(df, {
        "full": params, "no_merging": replace(params, merging="none"),
        "fewer_trees": replace(params, trees=max(1, params.trees // 2)),
        "gain_only": replace(params, alpha=1.0, beta=0.0)}, features, key, prepared)


def settings_grid(df: DataFrame, params: IndexParams, features=None, key=()) -> DataFrame:
    """The seven settings; those with as many initial bins share one merge history."""
    base = replace(params, **BASELINE)
    return run_settings(df, {name: replace(base, **change) for name, change in GRID.items()}, features, key)


def discretization_variants(spark, prepared: Prepared, aggressive: float = 0.1) -> DataFrame:
    """Equal-frequency, adaptive and aggressive bins of every column: bins, homogeneity, separation."""
    found = {"equal_frequency": [assess(a, h.initial, 0.0) for a, h in prepared.histories.items()],
             "adaptive": [discretize_adaptive(h) for h in prepared.histories.values()],
             "aggressive": [discretize(h, aggressive) for h in prepared.histories.values()]}
    out = None
    for name, ds in found.items():
        part = discretization_frame(spark, ds).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def build_times(df: DataFrame, sizes: Sequence[int], params: IndexParams, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(rows, seconds, test_r2): the time to build an index over the first rows of a table in key order, for several numbers of rows."""
    out = []
    for n in sizes:
        part = materialize(first_rows(df.select(*dict.fromkeys([*key, *features])), list(key), n))
        start = time.perf_counter()
        index = fit_index(part, features, params, key)
        out.append((n, time.perf_counter() - start, _row("", index)[4]))
    return df.sparkSession.createDataFrame(out, "rows bigint, seconds double, test_r2 double")


def batch_times(index: QualityIndex, df: DataFrame, sizes: Sequence[int], key: Sequence[str]) -> DataFrame:
    """(rows, seconds, rows_per_second): the time to score batches of several sizes, each run once before it counts."""
    out = []
    for n in sizes:
        batch = materialize(first_rows(df.select(*dict.fromkeys([*key, *index.inputs])), list(key), n))
        for _ in range(2):
            start = time.perf_counter()
            index.transform(batch).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        out.append((n, took, n / took))
    return df.sparkSession.createDataFrame(out, "rows bigint, seconds double, rows_per_second double")
