"""Quality of single rows: completeness, range conformance and consistency."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..core import COUNT, clean, numeric_columns, quoted
from ..functions.quantiles import fit_quantiles

ROW_METRICS = ("row_completeness", "row_range_conformance", "row_consistency")
SMALL_MEAN = 1e-10


@dataclass(frozen=True)
class RowMetricsModel:
    """Fitted ranges and typical spread; `transform` adds the three row metrics."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    typical_cv: float = 1.0

    def transform(self, df: DataFrame, metrics: Sequence[str] = ROW_METRICS) -> DataFrame:
        sql = {"row_completeness": self._completeness(), "row_range_conformance": self._conformance(),
               "row_consistency": self._consistency()}
        kept = [quoted(c) for c in df.columns]
        spread = _with_spread(clean(df), self.numeric) if "row_consistency" in metrics else clean(df)
        return spread.selectExpr(*kept, *[f"{sql[m]} AS {m}" for m in metrics])

    def _completeness(self) -> str:
        filled = " + ".join(f"CAST({quoted(c)} IS NOT NULL AS INT)" for c in self.columns)
        return f"CAST({filled} AS DOUBLE) / {len(self.columns)}" if self.columns else "0D"

    def _conformance(self) -> str:
        known = [c for c in self.numeric if c in self.ranges]
        if not known:
            return "1D"
        # A NULL comparison counts neither as inside nor as present.
        inside = " + ".join(f"coalesce(CAST({quoted(c)} >= {self.ranges[c][0]!r}D AND {quoted(c)} <= {self.ranges[c][1]!r}D AS INT), 0)"
                            for c in known)
        present = " + ".join(f"CAST({quoted(c)} IS NOT NULL AS INT)" for c in known)
        return f"coalesce(try_divide(CAST({inside} AS DOUBLE), {present}), 1D)"

    def _consistency(self) -> str:
        t = f"{float(self.typical_cv)!r}D"
        score = f"exp(-abs(sqrt(__ss / __n) / abs(__mean) - {t}) / {t})" if self.typical_cv > 0 else "1D"
        return f"IF(__n < 2 OR abs(__mean) < {SMALL_MEAN!r}D, 1D, least(1D, greatest(0D, {score})))"

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "numeric": self.numeric, "ranges": self.ranges,
                           "typical_cv": self.typical_cv})

    @staticmethod
    def from_json(text: str) -> "RowMetricsModel":
        d = json.loads(text)
        return RowMetricsModel(tuple(d["columns"]), tuple(d["numeric"]),
                               {c: tuple(r) for c, r in d["ranges"].items()}, d["typical_cv"])


def _with_spread(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Add count, mean and squared deviations of a row's numbers."""
    x = [f"CAST({quoted(c)} AS DOUBLE)" for c in numeric]
    n = " + ".join(f"CAST({quoted(c)} IS NOT NULL AS INT)" for c in numeric) or "0"
    total = " + ".join(f"coalesce({v}, 0D)" for v in x) or "0D"
    first = df.selectExpr("*", f"{n} AS __n", f"try_divide({total}, {n}) AS __mean")
    squares = " + ".join(f"coalesce(({v} - __mean) * ({v} - __mean), 0D)" for v in x) or "0D"
    return first.selectExpr("*", f"{squares} AS __ss")


def fit_row_metrics(df: DataFrame, columns: Sequence[str] | None = None, first_rows: int | None = None,
                    key: Sequence[str] = (), quartiles: dict[str, list[float]] | None = None) -> RowMetricsModel:
    """Learn quartile ranges and the median of sd/|mean| per row.

    The latter uses all rows; with a key and `first_rows`, only so many rows in key order. Counted rows (with COUNT) weigh as many.
    `quartiles` brings the columns' first and third along.
    """
    cols = list(columns or (c for c in df.columns if c != COUNT))
    numeric = numeric_columns(df, cols)
    weight = [COUNT] if COUNT in df.columns else []
    data = clean(df)
    found = fit_quantiles(data, numeric, (0.25, 0.75)) if quartiles is None else {c: quartiles[c] for c in numeric if c in quartiles}
    ranges = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in found.items()}
    head = data.orderBy(*key).limit(first_rows) if key and first_rows else data
    cv = _with_spread(head.select(*numeric, *weight), numeric).filter("__n > 1 AND __mean <> 0").selectExpr(
        "sqrt(__ss / __n) / abs(__mean) AS cv", *weight)
    typical = fit_quantiles(cv, ["cv"], (0.5,)).get("cv", [1.0])[0]
    return RowMetricsModel(tuple(cols), tuple(numeric), ranges, float(typical))
