"""Text columns as attributes: their values numbered by quality, so that bins of them can be made and merged.

Values have no order of their own. Sorted by the quality of their rows, the values nearest in quality are neighbours;
on the resulting codes equal-frequency bins, merges of neighbours and lookups work as on any numeric column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import clean, is_numeric, materialize, quoted, total
from ..functions.positions import numbered
from .bins import BIN_METRICS
from .metrics import default_catalog

SUFFIX = "_code"
ORDER_WEIGHTS = {"overall_quality": 1.0}


def text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not is_numeric(df.schema[c].dataType)]


def category_quality(df: DataFrame, column: str, columns: Sequence[str], metrics: Sequence[str] = BIN_METRICS) -> DataFrame:
    """(value, n, one column per metric): the quality of the rows of every value, nulls apart."""
    rows = clean(df.select(*dict.fromkeys([column, *columns]))).filter(F.col(column).isNotNull())
    # The column itself is the key, so its copy stands for it among the measured ones.
    keyed = rows.withColumn("__value", F.col(column)).select("__value", *columns)
    found = default_catalog().compute_wide(keyed, list(metrics), keys=["__value"])
    sizes = keyed.groupBy("__value").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "__value").select(F.col("__value").alias("value"), "n", *metrics)


def fit_categories(df: DataFrame, column: str, columns: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(value, code): every value numbered from 0, worst quality first; equal quality by value. Written once.

    `weights` weigh the bin metrics; rates and shapes count negatively.
    """
    w = weights or ORDER_WEIGHTS
    better = dict(default_catalog().directions())
    found = category_quality(df, column, columns, list(w))
    score = total(F.lit(float(x) if better[m] else -float(x)) * F.coalesce(F.col(m), F.lit(0.0)) for m, x in w.items())
    # Rounded, so that values of the same quality are not ordered by the last bit of a sum.
    ranked = numbered(materialize(found.select("value", F.round(score, 9).alias("__score"))), [], [F.col("__score").asc(), F.col("value").asc()], "__at")
    return materialize(ranked.select("value", F.col("__at").cast("double").alias("code")))


def encode(df: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    """Add <column>_code; nulls and values that were not there have none. A missing column's code is null. Works on streams."""
    for c, mapping in mappings.items():
        name = c + SUFFIX
        if c not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
            continue
        known = mapping.select(F.col("value").alias("__value"), F.col("code").alias(name))
        df = df.join(known, F.col(quoted(c)) == F.col("__value"), "left").drop("__value")
    return df
