"""Alerts from predicted quality, and reports against thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import quoted
from .metrics import default_catalog

# Default warning and critical limits.
ALERT_THRESHOLDS = {
    "completeness": {"warning": 0.95, "critical": 0.90},
    "outlier_rate": {"warning": 0.05, "critical": 0.10},
    "duplicate_rate": {"warning": 0.05, "critical": 0.10},
    "consistency_score": {"warning": 0.95, "critical": 0.90},
    "constraint_satisfaction": {"warning": 0.95, "critical": 0.90},
    "overall_quality": {"warning": 0.90, "critical": 0.80},
}
QUALITY_LEVELS = ((0.9, "Excellent"), (0.7, "Good"), (0.5, "Fair"))
ALERT_COLUMNS = ("ts", "tuple_id", "metric", "predicted_value", "threshold", "severity")


def higher_is_better(metric: str) -> bool:
    """The catalog's direction; for other names, rates are better when low."""
    known = dict(default_catalog().directions())
    return known[metric] if metric in known else "rate" not in metric.lower()


def _crossed(metric: str, value: str, limit: float) -> str:
    return f"{value} {'<' if higher_is_better(metric) else '>'} {float(limit)!r}D"


def alerts(scores: DataFrame, key: str | Column, thresholds: dict[str, dict[str, float]] | None = None,
           metrics: Sequence[str] | None = None, prefix: str = "pred_", ts: Column | None = None) -> DataFrame:
    """One row per crossed limit: ts, tuple_id, metric, predicted_value, threshold, severity.

    A critical alert hides the warning. Metrics without limits are skipped. Row-wise, so it works on
    streams as well.
    """
    limits = thresholds or ALERT_THRESHOLDS
    have = [c[len(prefix):] for c in scores.columns if c.startswith(prefix)] if metrics is None else list(metrics)
    cells = []
    for m in (m for m in have if m in limits):
        v, lim = quoted(prefix + m), limits[m]
        levels = [s for s in ("critical", "warning") if s in lim]
        cases = lambda out: "CASE " + " ".join(f"WHEN {_crossed(m, v, lim[s])} THEN {out(s)}" for s in levels) + " END"
        if levels:
            cells.append(f"struct('{m}' AS metric, {v} AS predicted_value, {cases(lambda s: f'{float(lim[s])!r}D')} AS threshold, "
                         f"{cases(lambda s: repr(s))} AS severity)")
    tuple_id = F.col(key) if isinstance(key, str) else key
    rows = scores.withColumn("__id", tuple_id).withColumn("__ts", ts if ts is not None else F.current_timestamp())
    if not cells:
        cells = ["struct('' AS metric, 0D AS predicted_value, 0D AS threshold, CAST(NULL AS STRING) AS severity)"]
    return rows.selectExpr("__ts AS ts", "__id AS tuple_id", f"inline(array({', '.join(cells)}))").filter("severity IS NOT NULL")


def alert_statistics(found: DataFrame, n_processed: int | DataFrame) -> DataFrame:
    """One row: n_processed, n_alerts, alert_rate, n_critical, n_warning, alerts_by_metric."""
    n = n_processed.count() if isinstance(n_processed, DataFrame) else n_processed
    per = found.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("c"))
    return per.agg(
        F.lit(n).cast("bigint").alias("n_processed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_alerts"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(max(n, 1)))).alias("alert_rate"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_critical"), F.coalesce(F.sum(F.col("n") - F.col("c")), F.lit(0)).alias("n_warning"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "n")))).alias("alerts_by_metric"))


def threshold_report(report: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Add threshold and passed to (metric, value) rows; metrics without a threshold are left out."""
    rules = ", ".join(f"struct('{m}' AS m, {float(t)!r}D AS threshold, {str(higher_is_better(m)).lower()} AS up)" for m, t in thresholds.items())
    hit = report.selectExpr("*", f"try_element_at(filter(array({rules}), r -> r.m = metric), 1) AS r")
    return hit.filter("r IS NOT NULL").selectExpr(
        *map(quoted, report.columns), "r.threshold AS threshold", "IF(r.up, value >= r.threshold, value <= r.threshold) AS passed")


def quality_level(value: Column) -> Column:
    """Excellent, Good, Fair or Poor."""
    out = None
    for limit, name in QUALITY_LEVELS:
        out = F.when(value >= limit, name) if out is None else out.when(value >= limit, name)
    return out.otherwise("Poor")
