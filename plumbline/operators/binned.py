"""Any metric of the catalog for every bin, and for every union of neighbouring bins.

A metric's State is aggregated once per (attribute, bin). A union's state is the sum (or minimum, maximum) of its bins'
states, so the metric of a merged bin is exact without reading rows again. Distinct values do not add up, but can be
told apart by the bin they were last seen in: a value counts for a union where its bin lies in the union and the
last one before does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Distinct, Lookup, MetricSpec, State
from ..core import materialize, quoted
from .bins import assign_bins, by_bin
from .metrics import default_catalog

KEYS = ["attr", "bin_id"]
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def specs_of(configs: dict[str, dict], catalog: Catalog | None) -> list[tuple[str, MetricSpec, dict]]:
    """(name in the result, metric, configuration). A name may be 'metric:label', to measure a metric several times."""
    known = catalog or default_catalog()
    return [(name, known[name.split(":")[0]], cfg) for name, cfg in configs.items()]


def _parts(binned: DataFrame, attrs: Sequence[str], df: DataFrame, specs: Sequence[tuple[str, MetricSpec, dict]]
           ) -> tuple[DataFrame | None, dict[str, State], list[tuple[str, DataFrame, Distinct]]]:
    """States per bin in one table (columns name__part), the States, and per distinct metric (attr, bin_id, seen, distinct, rows)."""
    rows = by_bin(binned, attrs, df.columns)
    states: dict[str, State] = {}
    fused, tables, counted = [], [], []
    for name, spec, cfg in specs:
        made = spec.state(df, **cfg)
        if isinstance(made, Distinct):
            # Equal values are combined first; a value has one row per bin, so the window's groups are small.
            seen = rows.groupBy(*KEYS, *made.columns).agg(F.count(F.lit(1)).alias("__n"))
            by = ", ".join(["attr", *map(quoted, made.columns)])
            seen = seen.withColumn("__seen", F.expr(f"coalesce(lag(bin_id) over (partition by {by} order by bin_id), -1)"))
            counted.append((name, seen.groupBy(*KEYS, F.col("__seen").alias("seen")).agg(
                F.count(F.lit(1)).alias("distinct"), F.sum("__n").alias("rows")), made))
            continue
        state = made.state if isinstance(made, Lookup) else made
        states[name] = state
        aggs = [c.alias(f"{name}__{part}") for part, c in state.update.items()]
        if isinstance(made, Lookup):
            counts = rows.groupBy(*KEYS, *made.columns).agg(F.count(F.lit(1)).alias("__n"))
            tables.append(made.join(counts).groupBy(*KEYS).agg(*aggs))
        else:
            fused += aggs
    if fused:
        tables.insert(0, rows.groupBy(*KEYS).agg(*fused))
    both = reduce(lambda a, b: a.join(b, KEYS, "full"), tables) if tables else None
    return both, states, counted


def _finished(table: DataFrame, keys: Sequence[str], states: dict[str, State]) -> DataFrame:
    out = [state.finish(lambda part, n=name: F.col(quoted(f"{n}__{part}"))).cast("double").alias(name) for name, state in states.items()]
    return table.select(*keys, *out)


def bin_metrics(df: DataFrame, boundaries: dict[str, Sequence[float]], configs: dict[str, dict],
                catalog: Catalog | None = None) -> DataFrame:
    """(attr, bin_id, one column per metric) of every non-empty bin. A user's aggregate without a State is measured directly."""
    specs = specs_of(configs, catalog)
    binned, attrs = assign_bins(df, boundaries, null_bin=None), list(boundaries)
    rows = by_bin(binned, attrs, df.columns)
    table, states, counted = _parts(binned, attrs, df, [s for s in specs if s[1].state is not None])
    found = [] if table is None else [_finished(table, KEYS, states)]
    for name, seen, distinct in counted:
        sums = seen.groupBy(*KEYS).agg(F.sum("distinct").alias("d"), F.sum("rows").alias("r"))
        found.append(sums.select(*KEYS, distinct.finish(F.col("r"), F.col("d")).alias(name)))
    for name, spec, cfg in specs:
        if spec.state is None:
            found.append(spec.build(rows, KEYS, **cfg).withColumnRenamed("value", name))
    return reduce(lambda a, b: a.join(b, KEYS, "full"), found)


def union_metrics(df: DataFrame, boundaries: dict[str, Sequence[float]], configs: dict[str, dict],
                  catalog: Catalog | None = None) -> DataFrame:
    """(attr, first, last, metric, value) of every union of neighbouring bins; its size depends on the bins only."""
    specs = specs_of(configs, catalog)
    without = [name for name, spec, _ in specs if spec.state is None]
    if without:
        raise ValueError(f"metrics without a State cannot be merged: {', '.join(without)}")
    binned, attrs = assign_bins(df, boundaries, null_bin=None), list(boundaries)
    table, states, counted = _parts(binned, attrs, df, specs)
    unions = df.sparkSession.createDataFrame([(a, f, l) for a, bs in boundaries.items() for f in range(len(bs) - 1) for l in range(f, len(bs) - 1)],
                                             "attr string, first int, last int")
    keys, out = ["attr", "first", "last"], []

    def inside(part: DataFrame) -> DataFrame:
        return unions.join(materialize(part), "attr").filter("bin_id between first and last")

    if table is not None:
        how = {f"{name}__{part}": state.merge.get(part, "sum") for name, state in states.items() for part in state.update}
        merged = inside(table).groupBy(*keys).agg(*[_MERGE[h](quoted(c)).alias(c) for c, h in how.items()])
        out.append(_long(_finished(merged, keys, states), keys, list(states)))
    for name, seen, distinct in counted:
        first_here = F.when(F.col("seen") < F.col("first"), F.col("distinct")).otherwise(0)
        sums = inside(seen).groupBy(*keys).agg(F.sum(first_here).alias("d"), F.sum("rows").alias("r"))
        out.append(_long(sums.select(*keys, distinct.finish(F.col("r"), F.col("d")).alias(name)), keys, [name]))
    return reduce(DataFrame.unionByName, out)


def _long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    cells: list[Column] = [F.struct(F.lit(n).alias("metric"), F.col(quoted(n)).cast("double").alias("value")) for n in names]
    return wide.select(*keys, F.inline(F.array(*cells)))
