"""Catalog of metrics: names, categories, direction, and how each becomes a Spark plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import clean, materialize, same_keys

CATEGORIES = ("completeness", "outliers", "duplicates", "consistency", "constraints",
              "distribution", "timeliness", "accuracy", "composite", "custom")


@dataclass(frozen=True)
class State:
    """A metric as numbers of which those of a union follow from those of its parts.

    `update` holds aggregates over rows, `merge` says how two of them combine where that is not their sum ('min',
    'max'), and `finish` makes the metric of them, given a function from name to Column.
    """

    update: dict[str, Column]
    finish: Callable[[Callable[[str], Column]], Column]
    merge: dict[str, str] = field(default_factory=dict)

    def direct(self) -> Column:
        """The metric over the rows at hand, as one aggregate."""
        return self.finish(self.update.__getitem__)


@dataclass(frozen=True)
class Distinct:
    """A metric of the number of rows and of distinct values of some columns (NULLs are equal)."""

    columns: Sequence[str]
    finish: Callable[[Column, Column], Column]      # rows, distinct


@dataclass(frozen=True)
class Lookup:
    """A metric that compares values with another table: equal values are counted first (`__n`) and looked up once."""

    columns: Sequence[str]
    join: Callable[[DataFrame], DataFrame]
    state: State


@dataclass(frozen=True)
class MetricSpec:
    """A metric is either one aggregate expression or a plan of its own.

    `aggregate(df, **cfg)` gives an aggregate Column; such metrics share one pass over the table.
    `frame(df, keys, **cfg)` gives keys + `value`, for metrics that need more than one pass.
    A grouped-aggregate pandas UDF is an aggregate with `python=True` (it cannot share a pass).
    `state(df, **cfg)` gives a State, Distinct or Lookup, with which the metric can be merged over bins.
    """

    name: str
    category: str
    higher_is_better: bool
    description: str = ""
    requires_config: bool = False
    aggregate: Callable[..., Column] | None = None
    frame: Callable[..., DataFrame] | None = None
    python: bool = False
    derived: Callable[..., Column] | None = None   # from other metrics' columns of the same report
    needs: tuple[str, ...] = ()
    state: Callable[..., State | Distinct | Lookup] | None = None

    @property
    def worst(self) -> float:
        return 0.0 if self.higher_is_better else 1.0

    def build(self, df: DataFrame, keys: Sequence[str] = (), **cfg) -> DataFrame:
        """keys + value, one row per group (one row without keys). Lazy."""
        if self.frame is not None:
            return self.frame(df, list(keys), **cfg)
        return df.groupBy(*keys).agg(self.aggregate(df.drop(*keys), **cfg).alias("value"))


class Catalog:
    def __init__(self) -> None:
        self._metrics: dict[str, MetricSpec] = {}

    def register(self, metric: MetricSpec) -> MetricSpec:
        if metric.name in self._metrics:
            raise ValueError(f"metric {metric.name!r} is already registered")
        if metric.aggregate is None and metric.frame is None:
            raise ValueError(f"metric {metric.name!r} needs an aggregate or a frame")
        self._metrics[metric.name] = metric
        return metric

    def register_aggregate(self, name: str, aggregate: Callable[..., Column], *, description: str = "",
                           category: str = "custom", higher_is_better: bool = True,
                           requires_config: bool = False, python: bool = False) -> MetricSpec:
        """Register a user's metric given as a function (df, **cfg) -> aggregate Column."""
        return self.register(MetricSpec(name, category, higher_is_better, description, requires_config,
                                        aggregate=aggregate, python=python))

    def register_state(self, name: str, state: Callable[..., State], *, description: str = "", category: str = "custom",
                       higher_is_better: bool = True, requires_config: bool = False) -> MetricSpec:
        """Register a user's metric given as a function (df, **cfg) -> State; it can also be measured over merged bins."""
        return self.register(MetricSpec(name, category, higher_is_better, description, requires_config,
                                        aggregate=lambda df, **cfg: state(df, **cfg).direct(), state=state))

    def __getitem__(self, name: str) -> MetricSpec:
        try:
            return self._metrics[name]
        except KeyError:
            raise ValueError(f"unknown metric {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._metrics

    def __len__(self) -> int:
        return len(self._metrics)

    def names(self, category: str | None = None) -> list[str]:
        return [m.name for m in self._metrics.values() if category in (None, m.category)]

    def categories(self) -> list[str]:
        return list(dict.fromkeys(m.category for m in self._metrics.values()))

    def free(self) -> list[str]:
        """Metrics that run without configuration."""
        return [m.name for m in self._metrics.values() if not m.requires_config]

    def compute(self, name: str, df: DataFrame, keys: Sequence[str] = (), **cfg) -> DataFrame:
        return self[name].build(clean(df), keys, **cfg)

    def compute_wide(self, df: DataFrame, names: Sequence[str], configs: dict[str, dict] | None = None,
                     keys: Sequence[str] = (), on_error: str = "raise") -> DataFrame:
        """keys + one column per metric. Single-expression metrics are fused into one pass.

        With `on_error='worst'` a metric that fails, while planning or while running, gets its worst value. This runs the
        report: metrics are measured together, and halved where that fails, until the failing ones are alone.
        """
        configs, keys, df = configs or {}, list(keys), clean(df)
        if on_error != "worst":
            return self._wide(df, list(names), configs, keys)
        # Groups and their sizes first: if not even these can be read, no metric is to blame.
        wide = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
        for some, table in self._guarded(df, list(names), configs, keys):
            wide = same_keys(wide, table, keys, "left") if keys else wide.withColumns({n: table.select(n).scalar() for n in some})
        return wide.select(*keys, *[F.col(n) if n in wide.columns else F.lit(self[n].worst).alias(n) for n in names])

    def _guarded(self, df: DataFrame, names: list[str], configs: dict[str, dict], keys: list[str]) -> list[tuple[list[str], DataFrame]]:
        """Tables of the metrics that could be measured."""
        if not names:
            return []
        try:
            return [(names, materialize(self._wide(df, names, configs, keys)))]
        except Exception:
            half = len(names) // 2
            return self._guarded(df, names[:half], configs, keys) + self._guarded(df, names[half:], configs, keys) if half else []

    def _wide(self, df: DataFrame, names: list[str], configs: dict[str, dict], keys: list[str]) -> DataFrame:
        values = df.drop(*keys)
        fused, frames, derived = [F.count(F.lit(1)).alias("__rows")], [], []
        wanted = list(names)
        for name in names:
            m, cfg = self[name], configs.get(name, {})
            if m.derived is not None and set(m.needs) <= set(wanted) and not any(configs.get(d) for d in m.needs):
                derived.append((name, m.derived(**cfg)))
            elif m.aggregate is not None and not m.python:
                fused.append(m.aggregate(values, **cfg).alias(name))
            else:
                frames.append((name, m.build(df, keys, **cfg)))
        wide = df.groupBy(*keys).agg(*fused).drop("__rows")
        for name, frame in frames:
            frame = frame.withColumnRenamed("value", name)
            if keys:
                wide = same_keys(wide, frame, keys, "left")
            else:
                wide = wide.withColumn(name, frame.select(name).scalar())
        for name, expr in derived:
            wide = wide.withColumn(name, expr)
        return wide.select(*keys, *wanted)

    def compute_all(self, df: DataFrame, configs: dict[str, dict] | None = None,
                    keys: Sequence[str] = (), category: str | None = None,
                    on_error: str = "raise") -> DataFrame:
        """keys + (metric, value): all metrics that need no configuration, and the configured ones."""
        configs = configs or {}
        names = [n for n in self.names(category) if not self[n].requires_config or n in configs]
        wide = self.compute_wide(df, names, configs, keys, on_error)
        return to_long(wide, list(keys), names)

    def compute_category(self, category: str, df: DataFrame, configs: dict[str, dict] | None = None,
                         keys: Sequence[str] = (), on_error: str = "raise") -> DataFrame:
        return self.compute_all(df, configs, keys, category, on_error)

    def directions(self) -> list[tuple[str, bool]]:
        return [(m.name, m.higher_is_better) for m in self._metrics.values()]


def to_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))

