"""Scores of attributes from their bins: information gain, share of rows in poor bins, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import attach, settings
from .bins import unpivot_quality

# Default weights and accepted ranges of bin metrics.
DEFAULT_WEIGHTS = {"completeness": 0.3, "outlier_rate": 0.3, "duplicate_rate": 0.2, "consistency_score": 0.2}
DEFAULT_THRESHOLDS = {"completeness": (0.95, 1.0), "outlier_rate": (0.0, 0.05), "duplicate_rate": (0.0, 0.05),
                      "constraint_violation_rate": (0.0, 0.05), "consistency_score": (0.9, 1.0)}
ALPHA, BETA = 0.7, 0.3
CATEGORIES, LOG_GUARD = 10, 1e-10


def entropy(df: DataFrame, column: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys + entropy in bits of a column's values; rows count once or by `weight`."""
    mass = F.sum(weight).cast("double") if weight else F.count(F.lit(1)).cast("double")
    parts = df.groupBy(*keys, column).agg(mass.alias("__m"))
    if keys:
        totals = parts.groupBy(*keys).agg(F.sum("__m").alias("all"))
        sized, everything = attach(parts, totals, keys), F.col("__s")["all"]
    else:
        sized, everything = parts, F.lit(float(df.agg(mass).first()[0] or 1))
    p = F.col("__m") / everything
    return sized.groupBy(*keys).agg(F.coalesce(-F.sum(p * F.log2(p + LOG_GUARD)), F.lit(0.0)).alias("entropy"))


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return settings(spark, [(m, float(w)) for m, w in weights.items()], "metric string, weight double")


def information_gain(bins: DataFrame, weighting: str = "bins") -> DataFrame:
    """(attr, metric, ig): entropy of the bins' values, cut into deciles when there are more than ten.

    Every bin counts once; `weighting='rows'` counts rows instead.
    """
    values = unpivot_quality(bins)
    probs = ", ".join(f"{i / CATEGORIES:.1f}D" for i in range(CATEGORIES + 1))
    edges = values.groupBy("attr", "metric").agg(
        F.count_distinct("value").alias("__distinct"),
        F.expr(f"array_sort(array_distinct(percentile(value, array({probs}))))").alias("__edges"))
    cut = values.join(edges, ["attr", "metric"]).withColumn("category", F.expr(
        f"IF(__distinct <= {CATEGORIES}, value, size(filter(slice(__edges, 2, greatest(size(__edges) - 2, 0)), e -> e < value)))"))
    found = entropy(cut, "category", ["attr", "metric"], "n" if weighting == "rows" else None)
    return found.withColumnRenamed("entropy", "ig")


def ig_multi(bins: DataFrame, weights: dict[str, float] | None = None, weighting: str = "bins") -> DataFrame:
    """(attr, ig_multi): weighted sum over metrics; a weighted metric the bins lack adds nothing."""
    w = weights_frame(bins.sparkSession, weights or DEFAULT_WEIGHTS)
    joined = information_gain(bins, weighting).join(w, "metric", "left")
    return joined.groupBy("attr").agg(F.coalesce(F.sum(F.col("ig") * F.col("weight")), F.lit(0.0)).alias("ig_multi"))


def issue_bins(bins: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None, missing: str = "skip") -> DataFrame:
    """(attr, bin_id, n, has_issue): any listed metric outside its range.

    A metric the bins lack is skipped; `missing='as_one'` takes it as 1.0.
    """
    default = "1D" if missing == "as_one" else "NULL"
    conds = []
    for metric, (low, high) in (thresholds or DEFAULT_THRESHOLDS).items():
        v = f"coalesce(quality['{metric}'], {default})"
        conds.append(f"coalesce({v} < {float(low)!r}D OR {v} > {float(high)!r}D, false)")
    return bins.selectExpr("attr", "bin_id", "n", f"{' OR '.join(conds) or 'false'} AS has_issue")


def qdp(bins: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None, missing: str = "skip") -> DataFrame:
    """(attr, qdp, n_bins, n_issue_bins): rows in issue bins / all rows of the bins."""
    return issue_bins(bins, thresholds, missing).groupBy("attr").agg(
        F.expr("coalesce(try_divide(CAST(sum(IF(has_issue, n, 0)) AS DOUBLE), sum(n)), 0D)").alias("qdp"),
        F.count(F.lit(1)).alias("n_bins"), F.count_if("has_issue").alias("n_issue_bins"))


def feature_scores(bins: DataFrame, weights: dict[str, float] | None = None,
                   thresholds: dict[str, tuple[float, float]] | None = None, alpha: float = ALPHA, beta: float = BETA,
                   missing: str = "skip", weighting: str = "bins") -> DataFrame:
    """(attr, ig_multi, qdp, importance, n_bins, n_issue_bins), most important first."""
    both = ig_multi(bins, weights, weighting).join(qdp(bins, thresholds, missing), "attr")
    out = both.withColumn("importance", F.lit(float(alpha)) * F.col("ig_multi") + F.lit(float(beta)) * F.col("qdp"))
    return out.select("attr", "ig_multi", "qdp", "importance", "n_bins", "n_issue_bins").orderBy(F.desc("importance"), "attr")


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("importance"), "attr").limit(k)


def weight_sensitivity(bins: DataFrame, mixes: Sequence[tuple[float, float]], k: int = 3,
                       weights: dict[str, float] | None = None, thresholds=None) -> DataFrame:
    """(alpha, beta, rank, attr, importance): the first k attributes under several mixes of the two scores."""
    mix = "array(" + ", ".join(f"struct({a!r}D AS alpha, {b!r}D AS beta)" for a, b in mixes) + ")"
    scored = feature_scores(bins, weights, thresholds).selectExpr("attr", "ig_multi", "qdp", f"inline({mix})")
    scored = scored.withColumn("importance", F.expr("alpha * ig_multi + beta * qdp"))
    order = W.partitionBy("alpha", "beta").orderBy(F.desc("importance"), "attr")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "alpha", "beta", "rank", "attr", "importance")
