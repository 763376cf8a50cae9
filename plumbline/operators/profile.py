"""Profiling: flags per row, column profiles, frequencies, missing-value patterns, schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import NESTED_TYPES, as_double, count_if, numeric_columns, quoted, ratio, settings
from ..functions.quantiles import fit_quantiles
from .metrics import outlier_limits, outside

# -- flags per row -------------------------------------------------------------------------------


def flag_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None,
                  name: str = "is_outlier") -> DataFrame:
    """Add a boolean column; a NULL value is no outlier. Default thresholds 1.5, 3.0 and 3.5."""
    t = {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5}[method] if threshold is None else threshold
    limits = outlier_limits(df, [column], method, t).get(column)
    flag = F.lit(False) if limits is None else F.coalesce(outside(as_double(column), limits), F.lit(False))
    return df.withColumn(name, flag)


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive; NULL is invalid as soon as a bound is given."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    if high is not None:
        ok = ok & (F.col(column) <= high)
    return F.coalesce(ok, F.lit(False))


def in_enum(column: str, values: Sequence) -> Column:
    known = [v for v in values if v is not None]
    ok = F.coalesce(F.col(column).isin(known), F.lit(False))
    return ok | F.col(column).isNull() if len(known) < len(values) else ok


def normalize(df: DataFrame, column: str, method: str = "minmax", name: str = "normalized") -> DataFrame:
    """minmax, zscore (sample deviation) or robust (median and quartile distance).

    A column without spread becomes 0.5 (minmax) or 0.0.
    """
    c = as_double(column)
    if method == "robust":
        q = fit_quantiles(df, [column], (0.25, 0.5, 0.75)).get(column)
        centre, spread, flat = (q[1], q[2] - q[0], 0.0) if q else (None, None, 0.0)
    elif method == "zscore":
        centre, spread, low, high = df.agg(F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).first()
        spread, flat = (None if low == high else spread), 0.0
    elif method == "minmax":
        low, high = df.agg(F.min(c), F.max(c)).first()
        centre, spread, flat = low, None if low is None else high - low, 0.5
    else:
        raise ValueError(f"unknown normalization {method!r}")
    if centre is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, (c - centre) / spread if spread else F.lit(flat))


# -- value counts and column profiles --------------------------------------------------------------

def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value as text, n) for every column, NULL included; repeats combine before the shuffle."""
    cols = list(columns or df.columns)
    text = [f"to_json({quoted(c)})" if isinstance(df.schema[c].dataType, NESTED_TYPES) else f"CAST({quoted(c)} AS STRING)"
            for c in cols]
    cells = ", ".join(f"struct('{c}' AS column, {t} AS value)" for c, t in zip(cols, text))
    return df.selectExpr(f"inline(array({cells}))").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, rows, missing, distinct values and the most common value."""
    cols = list(columns or df.columns)
    known = F.col("value").isNotNull()
    out = value_counts(df, cols).groupBy("column").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        count_if(known).alias("unique_count"),
        F.min_by(F.struct("value", "n"), F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("top"))
    kinds = F.create_map(*[F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())])
    share = lambda c: 100 * ratio(c, F.col("total_count"), 0.0)
    return out.select(
        "column", kinds[F.col("column")].alias("dtype"), "total_count", "missing_count",
        share(F.col("missing_count")).alias("missing_percentage"), "unique_count",
        share(F.col("unique_count")).alias("unique_percentage"),
        F.col("top.value").alias("most_common"), F.col("top.n").alias("most_common_count"),
        share(F.col("top.n")).alias("most_common_percentage"))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column; skewness and kurtosis are bias-corrected."""
    cols = numeric_columns(df, columns)
    medians = {c: q[0] for c, q in fit_quantiles(df, cols, (0.5,)).items()}
    aggs = []
    for i, c in enumerate(cols):
        x = f"CAST({quoted(c)} AS DOUBLE)"
        aggs.append(f"struct('{c}' AS column, min({x}) AS min, max({x}) AS max, avg({x}) AS mean, stddev_samp({x}) AS std, "
                    f"CAST(count({x}) AS DOUBLE) AS n, IF(min({x}) < max({x}), skewness({x}), 0D) AS g1, IF(min({x}) < max({x}), kurtosis({x}), NULL) AS g2, "
                    f"CAST({medians[c]!r} AS DOUBLE) AS median) AS s{i}" if c in medians else
                    f"struct('{c}' AS column, min({x}) AS min, max({x}) AS max, avg({x}) AS mean, stddev_samp({x}) AS std, "
                    f"CAST(count({x}) AS DOUBLE) AS n, 0D AS g1, CAST(NULL AS DOUBLE) AS g2, CAST(NULL AS DOUBLE) AS median) AS s{i}")
    one = df.selectExpr(*aggs)
    long = one.selectExpr(f"inline(array({', '.join(f's{i}' for i in range(len(cols)))}))")
    return long.selectExpr(
        "column", "min", "max", "mean", "median", "std",
        "IF(n >= 3, g1 * sqrt(n * (n - 1)) / nullif(n - 2, 0), NULL) AS skewness",
        "IF(n >= 4, coalesce((n - 1) / nullif((n - 2) * (n - 3), 0) * ((n + 1) * g2 + 6), 0D), NULL) AS kurtosis")


def constant_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Columns whose most common value makes up at least `threshold` of the non-null values."""
    per = value_counts(df).filter("value IS NOT NULL").groupBy("column").agg(
        (F.max("n") / F.sum("n")).alias("top_share"))
    return per.filter(F.col("top_share") >= threshold)


def high_cardinality_columns(df: DataFrame, threshold: float = 0.9, approximate: bool = False) -> DataFrame:
    """Columns with at least `threshold` distinct values per non-null value."""
    if approximate:
        cells = ", ".join(f"struct('{c}' AS column, approx_count_distinct({quoted(c)}) / nullif(count({quoted(c)}), 0) AS distinct_share)"
                          for c in df.columns)
        per = df.selectExpr(f"array({cells}) AS a").selectExpr("inline(a)")
    else:
        per = value_counts(df).filter("value IS NOT NULL").groupBy("column").agg(
            (F.count(F.lit(1)) / F.sum("n")).alias("distinct_share"))
    return per.filter(F.col("distinct_share") >= threshold)


def value_frequency(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most common values and their percentage of all rows; equal counts are ordered by value."""
    rows = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    size = df.count()
    top = rows.filter("value IS NOT NULL").orderBy(F.desc("count"), "value").limit(top_n)
    return top.withColumn("percentage", 100.0 * F.col("count") / F.lit(max(size, 1)))


# -- missing values --------------------------------------------------------------------------------

def missing_pattern(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pattern ARRAY<BOOLEAN>, count, percentage): which columns are missing together."""
    cols = list(columns or df.columns)
    mask = "array(" + ", ".join(f"{quoted(c)} IS NULL" for c in cols) + ")"
    found = df.selectExpr(f"{mask} AS pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    size = df.count()
    return found.withColumn("percentage", 100.0 * F.col("count") / F.lit(max(size, 1)))


def correlated_missing(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of columns whose missing values go together; works on the few distinct patterns."""
    cols = df.columns
    mask = "array(" + ", ".join(f"CAST({quoted(c)} IS NULL AS DOUBLE)" for c in cols) + ")"
    patterns = df.selectExpr(f"{mask} AS m").groupBy("m").agg(F.count(F.lit(1)).cast("double").alias("n"))
    last = len(cols) - 1
    pairs = patterns.selectExpr("m", "n", f"explode(sequence(0, {last})) AS i").filter(f"i < {last}").selectExpr(
        "m", "n", "i", f"explode(sequence(i + 1, {last})) AS j")
    sums = pairs.selectExpr("n", "i", "j", "m[i] AS x", "m[j] AS y").groupBy("i", "j").agg(
        F.expr("sum(n)").alias("n"), F.expr("sum(n * x)").alias("sx"), F.expr("sum(n * y)").alias("sy"),
        F.expr("sum(n * x * y)").alias("sxy"))
    names = "array(" + ", ".join(f"'{c}'" for c in cols) + ")"
    return sums.selectExpr(
        f"{names}[i] AS column_a", f"{names}[j] AS column_b",
        "try_divide(sxy - sx * sy / n, sqrt((sx - sx * sx / n) * (sy - sy * sy / n))) AS correlation",
    ).filter(F.abs("correlation") >= threshold).orderBy(F.desc(F.abs("correlation")), "column_a", "column_b")


# -- schema check ----------------------------------------------------------------------------------

def validate_schema(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """Rows (category, column, message) for missing columns, wrong types, ranges and required values.

    `schema`: column -> {type: int|float|str, min, max, required}.
    """
    spark, found = df.sparkSession, []
    kinds = {"int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType),
             "str": (T.StringType,)}
    checks = []
    for name, spec in schema.items():
        if name not in df.columns:
            found.append(("missing_columns", name, "column is missing"))
            continue
        dt = df.schema[name].dataType
        want = spec.get("type")
        if want in kinds and not isinstance(dt, kinds[want]):
            found.append(("type_errors", name, f"expected {want}, got {dt.simpleString()}"))
        c = quoted(name)
        if spec.get("required"):
            checks.append(("missing_required", name, "required column has nulls", f"{c} IS NULL"))
        if "min" in spec:
            checks.append(("range_errors", name, f"values below minimum {spec['min']}", f"{c} < {spec['min']}"))
        if "max" in spec:
            checks.append(("range_errors", name, f"values above maximum {spec['max']}", f"{c} > {spec['max']}"))
    fixed = settings(spark, found, "category string, column string, message string")
    if not checks:
        return fixed
    cells = ", ".join(f"struct('{k}' AS category, '{n}' AS column, '{m}' AS message, coalesce(bool_or({cond}), false) AS failed)"
                      for k, n, m, cond in checks)
    tested = df.selectExpr(f"array({cells}) AS a").selectExpr("inline(a)").filter("failed").drop("failed")
    return fixed.unionByName(tested)


