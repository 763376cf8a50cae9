"""The built-in table and column metrics, each for the whole table or per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Distinct, Lookup, MetricSpec, State
from ..core import (as_double, attach, clean, constant, count_if, is_numeric, materialize, numeric_columns, quoted, ratio,
                    same_keys, total)
from ..functions.quantiles import fit_quantiles, grouped_quantiles

# Text that counts as a number.
NUMBER_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# Fixed value: scales the median deviation of a normal sample to its standard deviation.
MAD_SCALE = 0.6745
MIN_FOR_OUTLIERS, MIN_FOR_SKEW, MIN_FOR_KURTOSIS = 4, 3, 4
DAY_MICROS, DECAY_DAYS = 86_400_000_000.0, 30.0
# Population deviation; exactly 0 for a constant column.
SPREAD = "IF(min({c}) = max({c}), 0D, stddev_pop(CAST({c} AS DOUBLE)))"
COMPOSITE_WEIGHTS = {"completeness": 0.5, "outlier_rate": 0.5}


# -- one aggregate expression each, as numbers that add up -------------------------------------

def _fixed(value: float) -> State:
    return State({"value": constant(value)}, lambda s: s("value"), {"value": "max"})


def _share(good: Column, seen: Column, default: float) -> State:
    return State({"good": good, "seen": seen}, lambda s: ratio(s("good"), s("seen"), default))


def completeness_state(df: DataFrame, columns: Sequence[str] | None = None) -> State:
    cols = list(columns or df.columns)
    return _share(total(F.count(c) for c in cols), F.count(F.lit(1)) * len(cols), 1.0)


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return completeness_state(df, columns).direct()


def column_completeness_state(df: DataFrame, column: str) -> State:
    return _share(F.count(column), F.count(F.lit(1)), 1.0) if column in df.columns else _fixed(1.0)


def column_completeness(df: DataFrame, column: str) -> Column:
    return column_completeness_state(df, column).direct()


def format_state(df: DataFrame, column: str, pattern: str | None = None) -> State:
    """Lengths of texts are whole numbers, so their sums give the exact variance."""
    if column not in df.columns:
        return _fixed(1.0)
    if pattern is not None:
        text = F.col(column).cast("string")
        return _share(count_if(text.rlike(f"^(?:{pattern})")), F.count(text), 1.0)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return _fixed(1.0)
    n = F.length(column).cast("decimal(38,0)")

    def finish(s):
        count, mean = s("n").cast("double"), F.try_divide(s("sum").cast("double"), s("n").cast("double"))
        off = F.greatest((s("n") * s("squares") - s("sum") * s("sum")).cast("double"), F.lit(0.0))
        spread = F.sqrt(F.try_divide(off, F.when(count > 1, count * (count - 1))))
        return F.coalesce(1 / (1 + F.try_divide(spread, mean)), F.lit(1.0))
    return State({"n": F.count(column).cast("decimal(18,0)"), "sum": F.sum(n).cast("decimal(18,0)"), "squares": F.sum(n * n).cast("decimal(20,0)")}, finish)


def format_consistency(df: DataFrame, column: str, pattern: str | None = None) -> Column:
    """Share of values starting with the pattern; without one, evenness of text lengths."""
    if column in df.columns and pattern is None and isinstance(df.schema[column].dataType, T.StringType):
        n = F.length(column)
        return F.coalesce(1 / (1 + F.try_divide(F.stddev_samp(n), F.avg(n))), F.lit(1.0))
    return format_state(df, column, pattern).direct()


def _check(df: DataFrame, constraint: dict) -> tuple[Column, Column] | None:
    """(violations, checks) of one constraint; None when it does not apply."""
    name, kind = constraint.get("column"), constraint.get("type")
    if name not in df.columns:
        return None
    c = F.col(name)
    if kind == "range":
        bad = F.lit(False)
        if constraint.get("min") is not None:
            bad = bad | (c < constraint["min"])
        if constraint.get("max") is not None:
            bad = bad | (c > constraint["max"])
    elif kind == "enum":
        bad = ~c.isin(list(constraint.get("values", [])))
    elif kind == "custom" and constraint.get("check") is not None:
        rule = constraint["check"]
        bad = ~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule(c), F.lit(False))
    else:
        return None
    return count_if(c.isNotNull() & bad), F.count(c)


def constraint_state(df: DataFrame, constraints: Sequence[dict]) -> State:
    parts = [p for p in (_check(df, c) for c in constraints) if p is not None]
    return _share(total(p[0] for p in parts), total(p[1] for p in parts), 0.0) if parts else _fixed(0.0)


def constraint_violation(df: DataFrame, constraints: Sequence[dict]) -> Column:
    """Violations per check over the non-null values. A custom check is SQL text or Column -> Column."""
    return constraint_state(df, constraints).direct()


def _valid(df: DataFrame, name: str, kind: str, strict: bool) -> Column:
    c, dt = F.col(name), df.schema[name].dataType
    if kind in ("int", "float"):
        if is_numeric(dt) or isinstance(dt, T.BooleanType):
            good = c.isNotNull()
        else:
            good = c.cast("string").rlike(NUMBER_TEXT)
        if strict and kind == "int":
            good = good & (c.cast("string").try_cast("double") % 1 == 0)
        return good
    if kind == "str":
        return c.isNotNull()
    if kind == "bool":
        if isinstance(dt, T.BooleanType):
            return c.isNotNull()
        return c.isin(0, 1) if is_numeric(dt) else F.lit(False)
    return c.try_cast(kind).isNotNull()


def type_state(df: DataFrame, expected_types: dict[str, str], strict: bool = False) -> State:
    known = {c: t for c, t in expected_types.items() if c in df.columns}
    good = total(count_if(F.col(c).isNotNull() & _valid(df, c, t, strict)) for c, t in known.items())
    return _share(good, total(F.count(c) for c in known), 1.0) if known else _fixed(1.0)


def type_validity(df: DataFrame, expected_types: dict[str, str], strict: bool = False) -> Column:
    """Types: int, float, str, bool, or any Spark type name (value must cast to it)."""
    return type_state(df, expected_types, strict).direct()


def _mean_shape(df: DataFrame, columns, fn, least: int) -> Column:
    # A constant column has no shape; merged partial moments may leave a rounding rest, so test for it.
    cols = numeric_columns(df, columns)
    vals = [F.when((F.count(c) >= least) & (F.min(c) < F.max(c)), F.abs(fn(as_double(c)))) for c in cols]
    return ratio(total(F.coalesce(v, F.lit(0.0)) for v in vals),
                 total(F.when(v.isNotNull(), 1).otherwise(0) for v in vals), 0.0)


def distribution_skewness(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return _mean_shape(df, columns, F.skewness, MIN_FOR_SKEW)


def distribution_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return _mean_shape(df, columns, F.kurtosis, MIN_FOR_KURTOSIS)


def _age_days(df: DataFrame, column: str, now: str | None) -> Column:
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.try_to_timestamp(c)
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return F.timestamp_diff("MICROSECOND", c.cast("timestamp"), at) / DAY_MICROS


def freshness_state(df: DataFrame, timestamp_column: str, current_time: str | None = None) -> State:
    if timestamp_column not in df.columns:
        return _fixed(0.0)
    age = _age_days(df, timestamp_column, current_time)
    return State({"age": F.sum(age), "n": F.count(age)}, lambda s: F.coalesce(F.exp(-F.try_divide(s("age"), s("n")) / DECAY_DAYS), F.lit(0.0)))


def freshness(df: DataFrame, timestamp_column: str, current_time: str | None = None) -> Column:
    """exp(-mean age in days / 30)."""
    return freshness_state(df, timestamp_column, current_time).direct()


# -- more than one pass ------------------------------------------------------------------------

def outlier_limits(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5
                   ) -> dict[str, tuple[float, float]]:
    """Fit the bounds outside which a value is an outlier; columns without values are left out.

    A column without spread has no outliers under the z-scores.
    """
    out: dict[str, tuple[float, float]] = {}
    if method == "iqr":
        for c, (q1, q3) in fit_quantiles(df, columns, (0.25, 0.75)).items():
            out[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return out
    if method == "zscore":
        row = df.agg(*[F.expr(e.format(c=quoted(c))).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, e in (("m", "avg({c})"), ("s", SPREAD))]).first()
        centre = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns) if row[f"m{i}"] is not None}
        scale = threshold
    elif method == "modified_zscore":
        med = {c: q[0] for c, q in fit_quantiles(df, columns, (0.5,)).items()}
        away = df.select(*[F.abs(as_double(c) - m).alias(c) for c, m in med.items()])
        centre = {c: (med[c], q[0]) for c, q in fit_quantiles(away, list(med), (0.5,)).items()}
        scale = threshold / MAD_SCALE
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    for c, (mid, spread) in centre.items():
        out[c] = (mid - scale * spread, mid + scale * spread) if spread else (-math.inf, math.inf)
    return out


def outside(c: Column, limits: tuple[float, float]) -> Column:
    return (c < limits[0]) | (c > limits[1])


def _group_limits(df: DataFrame, keys: Sequence[str], cols: Sequence[str], method: str, threshold: float) -> DataFrame:
    """keys + per column a struct (lo, hi); one row per group."""
    t, names = float(threshold), [quoted(c) for c in cols]
    by = [quoted(k) for k in keys]
    if method == "iqr":
        q = grouped_quantiles(df, cols, (0.25, 0.75), keys)
        return q.selectExpr(*by, *[f"struct({c}[0] - {t}D * ({c}[1] - {c}[0]) AS lo, {c}[1] + {t}D * ({c}[1] - {c}[0]) AS hi) AS {c}"
                                   for c in names])
    if method == "zscore":
        mid = df.groupBy(*keys).agg(*[F.expr(f"struct(avg({c}) AS m, {SPREAD.format(c=c)} AS s)").alias(raw)
                                      for c, raw in zip(names, cols)])
    else:
        med = grouped_quantiles(df, cols, (0.5,), keys)
        away = attach(df.select(*keys, *cols), med, keys).selectExpr(*by, *[f"abs({c} - __s.{c}[0]) AS {c}" for c in names])
        mid = attach(med, grouped_quantiles(away, cols, (0.5,), keys), keys).selectExpr(
            *by, *[f"struct({c}[0] AS m, __s.{c}[0] AS s) AS {c}" for c in names])
        t = t / MAD_SCALE
    return mid.selectExpr(*by, *[f"IF({c}.s > 0, struct({c}.m - {t}D * {c}.s AS lo, {c}.m + {t}D * {c}.s AS hi), NULL) AS {c}"
                                 for c in names])


def outlier_rate(df: DataFrame, keys: Sequence[str] = (), method: str = "iqr", threshold: float = 1.5,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Outlying cells / numeric cells, NULL cells included in the latter.

    Bounds are fitted first (quartiles, moments or median deviations), then one pass counts.
    """
    keys = list(keys)
    cols = [c for c in numeric_columns(df, columns) if c not in keys]
    if method not in ("iqr", "zscore", "modified_zscore"):
        raise ValueError(f"unknown outlier method {method!r}")
    if not cols:
        return df.groupBy(*keys).agg(constant(0.0).alias("value"))
    rows = df.select(*keys, *cols)
    if keys:
        # Written first: Spark then knows the size of the limits and sends them to the rows where they are few.
        rows = attach(rows, materialize(_group_limits(rows, keys, cols, method, threshold)), keys)
        limits = {c: (F.col("__s")[c]["lo"], F.col("__s")[c]["hi"]) for c in cols}
    else:
        limits = outlier_limits(rows, cols, method, threshold)
    bad = total(F.when(F.count(c) >= MIN_FOR_OUTLIERS, count_if(outside(as_double(c), b))).otherwise(0)
                for c, b in limits.items())
    return rows.groupBy(*keys).agg(ratio(bad, F.count(F.lit(1)) * len(cols), 0.0).alias("value"))


def distinct_rows(df: DataFrame, keys: Sequence[str], subset: Sequence[str]) -> DataFrame:
    """keys + `distinct` + `rows`; NULLs are equal. Repeats are combined before the shuffle."""
    seen = df.groupBy(*dict.fromkeys([*keys, *subset])).agg(F.count(F.lit(1)).alias("__n"))
    return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"), F.sum("__n").alias("rows"))


def duplicate_rate(df: DataFrame, keys: Sequence[str] = (), subset: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (subset or df.columns) if c not in keys]
    d = distinct_rows(df, list(keys), cols)
    return d.select(*keys, ratio(F.col("rows") - F.col("distinct"), F.col("rows"), 0.0).alias("value"))


def duplicate_state(df: DataFrame, subset: Sequence[str] | None = None) -> Distinct:
    return Distinct(list(subset or df.columns), lambda rows, distinct: ratio(rows - distinct, rows, 0.0))


def key_state(df: DataFrame, key_columns: Sequence[str] = ()) -> Distinct | State:
    if not key_columns or not set(key_columns) <= set(df.columns):
        return _fixed(0.0 if key_columns else 1.0)
    return Distinct(list(key_columns), lambda rows, distinct: ratio(distinct, rows, 1.0))


def key_uniqueness(df: DataFrame, keys: Sequence[str] = (), key_columns: Sequence[str] = ()) -> DataFrame:
    if not key_columns or not set(key_columns) <= set(df.columns):
        fixed = 0.0 if key_columns else 1.0
        return df.groupBy(*keys).agg(
            F.when(F.count(F.lit(1)) > 0, fixed).otherwise(1.0).alias("value"))
    d = distinct_rows(df, list(keys), list(key_columns))
    return d.select(*keys, ratio(F.col("distinct"), F.col("rows"), 1.0).alias("value"))


def referential_integrity(df: DataFrame, keys: Sequence[str] = (), foreign_key: str = "",
                          reference: DataFrame | None = None, reference_column: str | None = None) -> DataFrame:
    """Non-null values found in the reference / non-null values.

    The foreign key is counted per value first, so a hot value is one row in the join.
    """
    keys = list(keys)
    if foreign_key not in df.columns:
        return df.groupBy(*keys).agg(constant(1.0).alias("value"))
    ref = reference.select(F.col(reference_column or reference.columns[0]).alias("__ref")).distinct()
    used = df.groupBy(*keys, F.col(foreign_key).alias("__fk")).agg(F.count(foreign_key).alias("__n"))
    hit = used.join(ref, F.col("__fk") == F.col("__ref"), "left")
    found = F.sum(F.when(F.col("__ref").isNotNull(), F.col("__n")).otherwise(0))
    return hit.groupBy(*keys).agg(ratio(found, F.sum("__n"), 1.0).alias("value"))


def reference_state(df: DataFrame, foreign_key: str = "", reference: DataFrame | None = None,
                    reference_column: str | None = None) -> Lookup | State:
    if foreign_key not in df.columns:
        return _fixed(1.0)
    ref = reference.select(F.col(reference_column or reference.columns[0]).alias("__ref")).distinct()
    found = F.sum(F.when(F.col("__ref").isNotNull(), F.col("__n")).otherwise(0))
    used = F.sum(F.when(F.col(foreign_key).isNotNull(), F.col("__n")).otherwise(0))
    return Lookup([foreign_key], lambda counts: counts.join(ref, F.col(foreign_key) == F.col("__ref"), "left"), _share(found, used, 1.0))


def accuracy_state(df: DataFrame, column: str = "", ground_truth: DataFrame | None = None, on: Sequence[str] = (),
                   truth_column: str | None = None) -> Lookup | State:
    if column not in df.columns:
        return _fixed(0.0)
    truth = ground_truth.select(*on, F.col(truth_column or column).alias("__true"))
    c, t, n = F.col(column), F.col("__true"), F.col("__n")
    if is_numeric(df.schema[column].dataType):
        off = F.abs(F.try_divide(c.cast("double") - t.cast("double"), t.cast("double")))
        state = State({"off": F.sum(off * n), "n": F.sum(F.when(off.isNotNull(), n).otherwise(0)), "rows": F.sum(n)}, lambda s: F.when(
            s("rows") > 0, F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(s("off"), s("n").cast("double"))), F.lit(1.0))).otherwise(0.0))
    else:
        state = _share(F.sum(F.when(c == t, n).otherwise(0)), F.sum(n), 0.0)
    return Lookup(list(dict.fromkeys([*on, column])), lambda counts: same_keys(counts, truth, list(on)), state)


def value_accuracy(df: DataFrame, keys: Sequence[str] = (), column: str = "", ground_truth: DataFrame | None = None,
                   on: Sequence[str] = (), truth_column: str | None = None) -> DataFrame:
    """Closeness of a column to the true values of the rows with the same key."""
    keys, on = list(keys), list(on)
    if column not in df.columns:
        return df.groupBy(*keys).agg(constant(0.0).alias("value"))
    truth = ground_truth.select(*[F.col(k) for k in on], F.col(truth_column or column).alias("__true"))
    rows = same_keys(df.select(*dict.fromkeys([*keys, *on, column])), truth, on)
    c, t = F.col(column), F.col("__true")
    if is_numeric(df.schema[column].dataType):
        c, t = c.cast("double"), t.cast("double")
        off = F.avg(F.abs(F.try_divide(c - t, t)))
        score = F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - off), F.lit(1.0)))
    else:
        score = ratio(count_if(c == t), F.count(F.lit(1)), 0.0)
    return rows.groupBy(*keys).agg(score.alias("value"))


def composite(metric_weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over columns completeness, outlier_rate and duplicate_rate (rates inverted)."""
    weights = COMPOSITE_WEIGHTS if metric_weights is None else metric_weights
    terms = {"completeness": F.col("completeness"), "outlier_rate": 1 - F.col("outlier_rate"),
             "duplicate_rate": 1 - F.col("duplicate_rate")}
    used = {m: w for m, w in weights.items() if m in terms}
    weight = float(sum(used.values()))
    if weight == 0:
        return F.lit(1.0)
    return total(w * terms[m] for m, w in used.items()) / weight


def overall_quality(df: DataFrame, keys: Sequence[str] = (),
                    metric_weights: dict[str, float] | None = None) -> DataFrame:
    weights = COMPOSITE_WEIGHTS if metric_weights is None else metric_weights
    names = [m for m in ("completeness", "outlier_rate", "duplicate_rate") if m in weights]
    wide = default_catalog().compute_wide(df, names or ["completeness"], keys=keys)
    return wide.select(*keys, composite(metric_weights).alias("value"))


# -- user-level metrics shown as examples --------------------------------------------------------

# Patterns and limits of the example metrics.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^(\d{3}-\d{3}-\d{4}|\d{10})$"


def pattern_share(df: DataFrame, column: str, pattern: str) -> Column:
    if column not in df.columns:
        return constant(1.0)
    return ratio(count_if(F.col(column).rlike(pattern)), F.count(column), 1.0)


def rule_share(df: DataFrame, rule: str, where: str = "true") -> Column:
    """Share of the rows picked by `where` that satisfy `rule` (an unknown answer fails)."""
    picked = F.coalesce(F.expr(where), F.lit(False))
    return ratio(count_if(picked & F.expr(rule)), count_if(picked), 1.0)


def freshness_linear(df: DataFrame, timestamp_column: str, current_time: str | None = None) -> Column:
    age = F.avg(_age_days(df, timestamp_column, current_time))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - age / DECAY_DAYS), F.lit(0.0))


def multi_column_consistency(df: DataFrame, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Each rule: (columns, SQL predicate), checked where all its columns are present."""
    good, seen = [], []
    for cols, rule in rules:
        both = total(F.col(c).isNull().cast("int") for c in cols) == 0
        seen.append(count_if(both))
        good.append(count_if(both & F.expr(rule)))
    return ratio(total(good), total(seen), 1.0)


def default_catalog() -> Catalog:
    """A new catalog with the built-in metrics."""
    cat = Catalog()
    for m in (
        MetricSpec("completeness", "completeness", True, "non-null cells / cells", aggregate=completeness, state=completeness_state),
        MetricSpec("column_completeness", "completeness", True, "non-null share of a column", True,
                   aggregate=column_completeness, state=column_completeness_state),
        MetricSpec("outlier_rate", "outliers", False, "outlying share of the numeric cells", frame=outlier_rate),
        MetricSpec("duplicate_rate", "duplicates", False, "share of repeated rows", frame=duplicate_rate, state=duplicate_state),
        MetricSpec("key_uniqueness", "duplicates", True, "distinct keys / rows", True, frame=key_uniqueness, state=key_state),
        MetricSpec("format_consistency", "consistency", True, "values that fit a pattern", True,
                   aggregate=format_consistency, state=format_state),
        MetricSpec("referential_integrity", "consistency", True, "values found in a reference", True,
                   frame=referential_integrity, state=reference_state),
        MetricSpec("constraint_violation", "constraints", False, "violations / checks", True,
                   aggregate=constraint_violation, state=constraint_state),
        MetricSpec("type_validity", "constraints", True, "values of the expected type", True,
                   aggregate=type_validity, state=type_state),
        MetricSpec("distribution_skewness", "distribution", False, "mean absolute skewness",
                   aggregate=distribution_skewness),
        MetricSpec("distribution_kurtosis", "distribution", False, "mean absolute excess kurtosis",
                   aggregate=distribution_kurtosis),
        MetricSpec("freshness", "timeliness", True, "exponential decay of the mean age", True, aggregate=freshness, state=freshness_state),
        MetricSpec("value_accuracy", "accuracy", True, "closeness to true values", True, frame=value_accuracy, state=accuracy_state),
        MetricSpec("overall_quality", "composite", True, "weighted mean of three metrics",
                   frame=overall_quality, derived=composite,
                   needs=("completeness", "outlier_rate", "duplicate_rate")),
    ):
        cat.register(m)
    return cat


def measure(name: str, df: DataFrame, keys: Sequence[str] = (), **cfg) -> DataFrame:
    """One built-in metric as keys + value."""
    return default_catalog()[name].build(clean(df), keys, **cfg)
