"""Choice of attributes under a budget of bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .discretize import Discretization, MergeHistory, assess

# Multiples of the base threshold tried to reduce a column's bins.
BASE_THRESHOLD, MULTIPLES, ATTEMPTS, CLOSE = 0.01, (2.0, 5.0, 10.0, 20.0, 50.0), 3, 2


@dataclass
class Chosen:
    attr: str
    rank: int
    importance: float
    result: Discretization | None
    n_bins: int
    adjusted: bool
    selected: bool


@dataclass
class Selection:
    rows: list[Chosen]
    budget: int

    @property
    def selected(self) -> list[Chosen]:
        return [r for r in self.rows if r.selected]

    @property
    def total_bins(self) -> int:
        return sum(r.n_bins for r in self.selected)

    @property
    def utilization(self) -> float:
        return self.total_bins / self.budget if self.budget > 0 else 0.0

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(r.attr, r.rank, float(r.importance), r.n_bins, r.adjusted, r.selected) for r in self.rows],
            "attr string, rank int, importance double, n_bins int, adjusted boolean, selected boolean")

    def summary(self, spark) -> DataFrame:
        rejected = [r.attr for r in self.rows if not r.selected]
        return spark.createDataFrame([(len(self.selected), self.total_bins, self.budget, self.utilization, rejected)],
                                     "n_selected int, total_bins int, budget int, utilization double, rejected array<string>")


def coarser(found: Discretization, history: MergeHistory, target: int, min_bins: int, attempts: int = ATTEMPTS,
            homogeneity: str = "rows") -> Discretization | None:
    """The result with the most bins, between min_bins and target, among a few larger thresholds."""
    done = len(history.initial) - len(found.bins)
    best = None
    for multiple in MULTIPLES[:attempts]:
        t = BASE_THRESHOLD * multiple
        bins = history.bins(t, skip=done)
        if min_bins <= len(bins) <= target and (best is None or len(bins) > len(best.bins)):
            best = assess(found.attr, bins, t, homogeneity)
        if target - CLOSE <= len(bins) <= target:
            break
    return best


def select_features(ranked: Sequence[tuple[str, float]], found: dict[str, Discretization],
                    histories: dict[str, MergeHistory], budget: int = 100, min_bins: int = 3,
                    attempts: int = ATTEMPTS, max_homogeneity: float | None = None,
                    min_separation: float | None = None, adjust: bool = True, homogeneity: str = "rows") -> Selection:
    """Walk down the ranking and take what fits; a column that does not fit may be made coarser.

    Limits on homogeneity and separation, where given, apply to the column as it would be taken.
    """
    rows, used = [], 0
    for rank, (attr, importance) in enumerate(ranked, 1):
        room, d, adjusted = budget - used, found[attr], False
        pick = d if len(d.bins) <= room else None
        if pick is None and room >= min_bins and adjust:
            pick = coarser(d, histories[attr], room, min_bins, attempts, homogeneity)
            adjusted = pick is not None
        if pick is not None and max_homogeneity is not None and pick.homogeneity > max_homogeneity:
            pick = None
        if pick is not None and min_separation is not None and pick.separation < min_separation:
            pick = None
        rows.append(Chosen(attr, rank, importance, pick, len((pick or d).bins), adjusted and pick is not None, pick is not None))
        used += len(pick.bins) if pick is not None else 0
    return Selection(rows, budget)

