"""Drift between a reference and a current table, column by column."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import is_numeric, quoted
from ..functions.quantiles import running_counts

SERIES_TERMS = 100


def _shared(ref: DataFrame, cur: DataFrame, numeric_only: bool, columns: Sequence[str] | None) -> list[str]:
    names = [c for c in ref.columns if c in cur.columns and (columns is None or c in columns)]
    return [c for c in names if not numeric_only or is_numeric(ref.schema[c].dataType)]


def _both_counts(ref: DataFrame, cur: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """(attr, v, r, c): how often each value occurs on either side."""
    cells = ", ".join(f"struct({i} AS attr, CAST({quoted(c)} AS {kind}) AS v)" for i, c in enumerate(cols))
    side = lambda df, r: df.selectExpr(f"inline(array({cells}))").selectExpr("attr", "v", f"{r}L AS r", f"{1 - r}L AS c")
    rows = side(ref.select(*cols), 1).unionAll(side(cur.select(*cols), 0)).filter("v IS NOT NULL")
    return rows.groupBy("attr", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _column_name(cols: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{c}'" for c in cols) + ")[attr] AS column"


def drift_ks(ref: DataFrame, cur: DataFrame, alpha: float = 0.05, columns: Sequence[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: (column, statistic, p_value, has_drift); p is asymptotic.

    Columns empty on one side are left out.
    """
    cols = _shared(ref, cur, True, columns)
    runs = running_counts(_both_counts(ref, cur, cols, "DOUBLE"), ["attr"], "v", "r", extra=["c"])
    top = runs.filter("size > 0 AND size_c > 0").groupBy("attr", "size", "size_c").agg(
        F.expr("max(abs((before + r) / size - (before_c + c) / size_c))").alias("statistic"))
    z = "statistic * sqrt(CAST(size AS DOUBLE) * size_c / (CAST(size AS DOUBLE) + size_c))"
    series = (f"IF({z} < 0.2D, 1D, least(1D, greatest(0D, 2 * aggregate(sequence(1, {SERIES_TERMS}), 0D, "
              f"(acc, k) -> acc + IF(k % 2 = 1, 1, -1) * exp(-2D * k * k * {z} * {z})))))")
    return top.selectExpr(_column_name(cols), "statistic", f"{series} AS p_value").withColumn(
        "has_drift", F.col("p_value") < alpha)


def drift_chi2(ref: DataFrame, cur: DataFrame, alpha: float = 0.05, columns: Sequence[str] | None = None) -> DataFrame:
    """Chi-squared of the current counts against the reference shares: (column, statistic, dof, p_value, has_drift).

    Expected counts are scaled to the current total. A value the reference lacks makes the statistic
    infinite and p zero.
    """
    cols = _shared(ref, cur, False, columns)
    counts = _both_counts(ref, cur, cols, "STRING")
    sizes = counts.groupBy("attr").agg(F.sum("r").alias("size_r"), F.sum("c").alias("size_c")).filter("size_r > 0 AND size_c > 0")
    rows = counts.join(sizes, ["attr"])
    term = "pow(c - r * CAST(size_c AS DOUBLE) / size_r, 2) / nullif(r * CAST(size_c AS DOUBLE) / size_r, 0)"
    out = rows.groupBy("attr").agg(
        F.expr(f"IF(bool_or(r = 0), CAST('Infinity' AS DOUBLE), sum({term}))").alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("dof"))
    out = out.selectExpr(_column_name(cols), "statistic", "dof").withColumn("p_value", _chi2_tail("statistic", "dof"))
    return out.withColumn("has_drift", F.col("p_value") < alpha)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution, one number per column of the table."""
    return pd.Series([_upper_gamma(d / 2.0, v / 2.0) for v, d in zip(x, dof)], dtype="float64")


def _upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function by integrating its density in log space."""
    if a <= 0 or np.isnan(x):
        return float("nan")
    if np.isinf(x):
        return 0.0
    if x <= 0:
        return 1.0
    # t = exp(u): the integrand exp(a*u - e^u) is smooth with a single peak at u = log(a).
    u = np.linspace(np.log(x), np.log(max(x, a) + 60 + 20 * np.sqrt(a + x)), 20001)
    v = np.linspace(np.log(x) - 60 / a - 5, np.log(x), 20001)
    peak = a * np.log(a) - a
    area = lambda s: float(np.trapezoid(np.exp(a * s - np.exp(s) - peak), s))
    upper, lower = area(u), area(v)
    return upper / (upper + lower)
