"""The index: bins of a few chosen columns, and a forest that predicts a row's quality from them."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import clean, count_rows, materialize, numeric_columns, quoted, same_keys, spread
from ..functions.quantiles import fit_counted
from .bins import assign_bins, bin_means, bin_quality, fit_boundaries, shares
from .categories import SUFFIX, encode, fit_categories, text_columns
from .discretize import (Discretization, MergeHistory, assess, bins_frame, collect_history, discretize,
                         discretize_adaptive, edges_of, merge_history)
from .forest import Forest, StoredForest, fit_forest
from .rows import ROW_METRICS, RowMetricsModel, fit_row_metrics
from .scoring import ALPHA, BETA, DEFAULT_THRESHOLDS, DEFAULT_WEIGHTS, feature_scores
from .selection import Selection, select_features



@dataclass(frozen=True)
class IndexParams:
    budget: int = 100
    n_bins: int = 30
    trees: int = 100
    depth: int = 20
    test_size: float = 0.2
    seed: int = 42
    alpha: float = ALPHA
    beta: float = BETA
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    thresholds: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    min_bins: int = 3
    target: str = "table"            # bins' metrics, or 'row' for the row metrics
    size_weight: str = "rows"        # 'share' makes merge thresholds independent of the table's size
    homogeneity: str = "rows"
    merging: str = "adaptive"        # 'fixed' (merge_threshold) or 'none'
    merge_threshold: float = 0.01    # the adaptive search begins with it
    rounds: int = 5
    adjust: bool = True
    null_bin: str = "first"          # 'own': rows without a value get a bin of their own
    category_weights: dict[str, float] | None = None         # bin metrics by whose weighted sum text values are ordered
    configs: dict[str, dict] = field(default_factory=dict)   # further catalog metrics of the bins, with their configuration

    @property
    def null_at(self) -> int | str:
        return "own" if self.null_bin == "own" else 0


@dataclass
class Prepared:
    """What every fit on the same table shares: row metrics, boundaries and the merge history."""

    columns: list[str]
    row_model: RowMetricsModel
    boundaries: dict[str, list[float]]
    histories: dict[str, MergeHistory]
    categories: dict[str, DataFrame] = field(default_factory=dict)      # text column -> value, code


def prepare(df: DataFrame, features: Sequence[str] | None = None, params: IndexParams = IndexParams()) -> Prepared:
    """Text columns among the features take part with their values numbered by quality."""
    cols = list(features or numeric_columns(df))
    texts = text_columns(df, cols)
    data = spread(clean(df if params.configs else df.select(*cols))) if texts or params.configs else df
    coded = {c: fit_categories(data, c, cols, params.category_weights) for c in texts}
    data = encode(data, coded)
    counted = count_rows(data, [*cols, *[c + SUFFIX for c in coded]])
    binned = [c + SUFFIX if c in coded else c for c in cols]
    # Quartiles and boundaries are looked up together: every look-up is a dozen jobs.
    quartiles, bounds = fit_counted(counted, numeric_columns(counted, [*cols, *binned]), lambda n: (0.25, 0.75), shares(params.n_bins))
    model = fit_row_metrics(counted, cols, first_rows=None, quartiles=quartiles)
    bs = fit_boundaries(counted, binned, params.n_bins, bounds)
    hist = merge_history(data if params.configs else counted, bs, cols, size_weight=params.size_weight, row_model=model, target=params.target, configs=params.configs)
    return Prepared(cols, model, bs, collect_history(hist, bs), coded)


# -- lookup ----------------------------------------------------------------------------------------

def lookup_quality(binned: DataFrame, quality: dict[str, list[dict[str, float]]], metrics: Sequence[str],
                   prefix: str = "bin_") -> DataFrame:
    """Add per metric the mean over the features of the quality of the row's bins."""
    outs = []
    for m in metrics:
        terms = [f"array({', '.join(f'{float(q.get(m, 0.0))!r}D' for q in qs)})[{quoted(prefix + a)}]" for a, qs in quality.items()]
        outs.append(f"({' + '.join(terms)}) / {len(terms)} AS {quoted(m)}")
    return binned.selectExpr("*", *outs)


def quality_of(bins: DataFrame) -> dict[str, list[dict[str, float]]]:
    """attr -> quality per bin, in bin order; a table of bins is small."""
    out: dict[str, list[dict[str, float]]] = {}
    for r in sorted(bins.collect(), key=lambda r: (r["attr"], r["bin_id"])):
        out.setdefault(r["attr"], []).append(dict(r["quality"]))
    return out


def bin_occupancy(binned: DataFrame, features: Sequence[str], prefix: str = "bin_") -> DataFrame:
    """(attr, bin_id, n): rows per feature and bin."""
    cells = ", ".join(f"struct('{a}' AS attr, {quoted(prefix + a)} AS bin_id)" for a in features)
    return binned.selectExpr(f"inline(array({cells}))").groupBy("attr", "bin_id").agg(F.count(F.lit(1)).alias("n"))


def category_bins(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, bin_id): every value numbered from 1, the most common first, equal counts by value.

    With `k` only the k most common get a bin; all other values share bin 0.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if k is not None:
        top = counts.orderBy(F.desc("n"), "value").limit(k)
        # The window sees the k rows just taken.
        return top.select("value", F.row_number().over(W.orderBy(F.desc("n"), "value")).alias("bin_id"))
    # Ranges of the order are numbered one by one and shifted by the sizes of the ranges before; written once, as
    # both need the same ranges.
    ranges = materialize(counts.repartitionByRange(F.desc("n"), F.asc("value")).withColumn("__part", F.spark_partition_id()))
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # The window sees one row per range.
    shift = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__shift"))
    at = F.row_number().over(W.partitionBy("__part").orderBy(F.desc("n"), "value"))
    return same_keys(ranges.withColumn("__at", at), shift, ["__part"]).select("value", (F.col("__shift") + F.col("__at")).alias("bin_id"))


def assign_categories(df: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    hit = df.join(mapping.select(F.col("value").alias("__v"), F.col("bin_id").alias("__b")), F.col(column) == F.col("__v"), "left")
    return hit.withColumn(name, F.coalesce("__b", F.lit(0))).drop("__v", "__b")


# -- the index -------------------------------------------------------------------------------------

@dataclass
class QualityIndex:
    features: list[str]
    boundaries: dict[str, list[float]]
    quality: dict[str, list[dict[str, float]]]
    metrics: list[str]
    model: Forest
    row_model: RowMetricsModel
    params: IndexParams
    fit_metrics: list[tuple] = field(default_factory=list)     # split, metric, mse, r2, mae
    info: dict = field(default_factory=dict)
    categories: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        """The columns of a table that predictions need."""
        codes = {c + SUFFIX: c for c in self.categories}
        return [codes.get(a, a) for a in self.features]

    def encode(self, df: DataFrame) -> DataFrame:
        return encode(df, {c: m for c, m in self.categories.items() if c + SUFFIX in self.features})

    def bin_vectors(self, df: DataFrame) -> DataFrame:
        return assign_bins(self.encode(df), {a: self.boundaries[a] for a in self.features}, self.params.null_at)

    def transform(self, df: DataFrame, with_bins: bool = False, distinct: bool = False) -> DataFrame:
        """Add pred_<metric> columns. Works on streams, without any shuffle.

        `distinct=True` (batch only) predicts every bin vector once and joins the result back: worth
        it when there are far fewer vectors than rows and the join side is small.
        """
        rows = self.bin_vectors(df)
        bins = [f"bin_{a}" for a in self.features]
        preds = [f"pred_{m}" for m in self.metrics]
        if distinct:
            scored = self.model.transform(rows.select(*bins).distinct()).select(*bins, *preds)
            out = same_keys(rows, scored, bins)
        else:
            out = self.model.transform(rows)
        return out.select(*df.columns, *(bins if with_bins else []), *preds)

    def importance(self, spark: SparkSession) -> DataFrame:
        """(attr, importance), scaled to sum 1."""
        return spark.createDataFrame(list(zip(self.features, self.model.importances())), "attr string, importance double")

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.fit_metrics, "split string, metric string, mse double, r2 double, mae double")

    def metadata(self) -> dict:
        overall = {s: (r2, mse) for s, m, mse, r2, _ in self.fit_metrics if m == "overall"}
        r2, mse = overall.get("test", (None, None))
        return {**self.info, "selected_features": self.features, "n_features_selected": len(self.features),
                "total_bins": sum(map(len, self.quality.values())), "budget": self.params.budget,
                "metric_names": self.metrics, "n_estimators": self.params.trees, "max_depth": self.params.depth,
                "test_r2": r2, "test_mse": mse}


def training_data(df: DataFrame, boundaries: dict[str, list[float]], quality: dict[str, list[dict[str, float]]],
                  row_model: RowMetricsModel, target: str = "table", keep: Sequence[str] = (),
                  null_bin: int | str = 0) -> tuple[DataFrame, list[str]]:
    """Bin columns and targets of every row: the bins' mean quality, or the row's own metrics."""
    data = clean(df)
    if target == "row":
        scored = row_model.transform(data)
        return assign_bins(scored, boundaries, null_bin).select(*keep, *[f"bin_{a}" for a in boundaries], *ROW_METRICS), list(ROW_METRICS)
    metrics = list(next(iter(quality.values()))[0])
    if null_bin == "own":
        # A bin without quality of its own counts as the attribute's mean.
        quality = {a: [*qs, {m: sum(q[m] for q in qs) / len(qs) for m in metrics}] for a, qs in quality.items()}
    rows = lookup_quality(assign_bins(data, boundaries, null_bin), quality, metrics)
    return rows.select(*keep, *[f"bin_{a}" for a in boundaries], *metrics), metrics


def _hash_split(cols: Sequence[str], test_size: float, seed: int) -> str:
    return f"IF(pmod(xxhash64({', '.join(map(quoted, cols))}, {seed}), 1000) < {int(test_size * 1000)}, 'test', 'train')"


def compress(training: DataFrame, bins: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per bin vector: its weight and mean targets.

    A regression tree's splits depend on sums per vector only, so nothing is lost, and equal vectors
    combine before the shuffle.
    """
    return training.groupBy(*bins).agg(F.count(F.lit(1)).cast("double").alias("__w"), *[F.avg(m).alias(m) for m in metrics])


def error_rows(scored: DataFrame, metrics: Sequence[str], split: str = "split", weight: str | None = None) -> list[tuple]:
    """(split, metric, mse, r2, mae) per metric and 'overall' (plain mean over metrics).

    Where the truth is constant, R2 is 1 for an exact prediction and 0 otherwise.
    """
    w = quoted(weight) if weight else "1D"
    means = scored.groupBy(split).agg(*[F.expr(f"sum({w} * {quoted(m)}) / sum({w})").alias(f"m{i}") for i, m in enumerate(metrics)]).collect()
    centre = {r[split]: r for r in means}
    aggs = []
    for i, m in enumerate(metrics):
        at = "map(" + ", ".join(f"'{s}', {float(r[f'm{i}'])!r}D" for s, r in centre.items()) + f")[{split}]"
        d = f"({quoted(m)} - {quoted('pred_' + m)})"
        aggs += [F.expr(f"sum({w} * {d} * {d}) / sum({w})").alias(f"e{i}"), F.expr(f"sum({w} * abs({d})) / sum({w})").alias(f"a{i}"),
                 F.expr(f"sum({w} * pow({quoted(m)} - {at}, 2)) / sum({w})").alias(f"v{i}"),
                 F.expr(f"min({quoted(m)}) = max({quoted(m)})").alias(f"c{i}")]
    out = []
    for r in (scored.groupBy(split).agg(*aggs).collect() if centre else []):
        per = []
        for i, m in enumerate(metrics):
            mse, var = r[f"e{i}"], r[f"v{i}"]
            flat = r[f"c{i}"] or var < 1e-24
            r2 = (1.0 if mse < 1e-20 else 0.0) if flat else 1 - mse / var
            per.append((r[split], m, mse, r2, r[f"a{i}"]))
        k = len(per)
        out += per + [(r[split], "overall", *(sum(x[j] for x in per) / k for j in (2, 3, 4)))]
    return sorted(out)


def choose(df: DataFrame, prep: Prepared, params: IndexParams) -> tuple[dict[str, Discretization], Selection]:
    """Merge, score and select; everything is read from the merge history."""
    found: dict[str, Discretization] = {}
    for a, h in prep.histories.items():
        if params.merging == "none":
            found[a] = assess(a, h.initial, 0.0, params.homogeneity)
        elif params.merging == "fixed":
            found[a] = discretize(h, params.merge_threshold, params.homogeneity)
        else:
            found[a] = discretize_adaptive(h, params.rounds, params.merge_threshold, homogeneity=params.homogeneity)
    weights, limits = params.weights, params.thresholds
    if params.target == "row" and not set(weights) & set(ROW_METRICS):
        weights = {m: 1.0 / len(ROW_METRICS) for m in ROW_METRICS}
    scores = feature_scores(bins_frame(df.sparkSession, list(found.values())), weights, limits, params.alpha, params.beta)
    ranked = [(r["attr"], r["importance"]) for r in scores.select("attr", "importance").collect()]
    return found, select_features(ranked, found, prep.histories, params.budget, params.min_bins, adjust=params.adjust,
                                  homogeneity=params.homogeneity)


def fit_index(df: DataFrame, features: Sequence[str] | None = None, params: IndexParams = IndexParams(),
              key: Sequence[str] = (), prepared: Prepared | None = None, shared: dict | None = None) -> QualityIndex:
    """Bins, merging, scores, selection, bin dictionary, training data and forests in one go.

    The split into training and test rows follows a hash of `key` (of all columns without one). `shared` is kept over several
    fits on one table: those that choose the same bins share their quality and the training table, and those whose trees grow
    alike the forest; fewer trees are the first ones of it.
    """
    start = time.time()
    prep = prepared or prepare(df, features, params)
    known = shared if shared is not None and not prep.categories else {}
    choice = repr((prep.row_model, prep.boundaries, replace(params, trees=0, depth=0)))
    if choice not in known:
        known[choice] = choose(df, prep, params)[1]
    selection = known[choice]
    picked = selection.selected
    if not picked:
        raise ValueError("no column fits the budget")
    names = [p.attr for p in picked]
    boundaries = {p.attr: edges_of(p.result) for p in picked}
    same = repr((names, boundaries, list(key), prep.row_model, params.target, params.null_bin, params.test_size, params.seed, params.configs))
    if same not in known:
        known[same] = _training(df, prep, names, boundaries, key, params)
    quality, metrics, table, weight, vectors = known[same]
    bins = [f"bin_{a}" for a in names]
    most = max(len(b) for b in boundaries.values())
    grown: StoredForest | None = known.get((same, params.depth))
    model = grown.first(params.trees) if grown is not None and grown.asked >= params.trees else None
    if model is None or not model.trees:
        model = known[same, params.depth] = fit_forest(vectors, bins, metrics, params.trees, params.depth, most, params.seed)
    index = QualityIndex(names, boundaries, quality, metrics, model, prep.row_model, params,
                         categories={c: m for c, m in prep.categories.items() if c + SUFFIX in names})
    errors = (same, params.depth, tuple(model.trees))
    if errors not in known:
        # Scored once; the errors take two passes.
        scored = materialize(model.transform(table).select("__split", *metrics, *[f"pred_{m}" for m in metrics], *([weight] if weight else [])))
        known[errors] = error_rows(scored, metrics, "__split", weight)
    index.fit_metrics = known[errors]
    index.info = {"n_features_total": len(prep.columns), "budget_utilization": selection.utilization,
                  "model_type": "RandomForest", "build_time": time.time() - start}
    return index


def _training(df: DataFrame, prep: Prepared, names: list[str], boundaries: dict[str, list[float]], key: Sequence[str],
              params: IndexParams) -> tuple[dict, list[str], DataFrame, str | None, DataFrame]:
    """The bins' quality, the targets' names, the table to score with its weight column, and the weighted training vectors."""
    data = spread(clean(df if params.configs else df.select(*dict.fromkeys([*key, *prep.columns]))))
    data = encode(data, {c: m for c, m in prep.categories.items() if c + SUFFIX in names})
    exact = (bin_means(prep.row_model.transform(data), boundaries, ROW_METRICS) if params.target == "row"
             else bin_quality(data, boundaries, prep.columns, params.configs))
    quality = quality_of(exact)
    quality = {a: quality[a] for a in names}
    rows, metrics = training_data(data.withColumn("__split", F.expr(_hash_split(list(key) or prep.columns, params.test_size, params.seed))),
                                  boundaries, quality, prep.row_model, params.target, keep=["__split"], null_bin=params.null_at)
    bins = [f"bin_{a}" for a in names]
    if params.target == "table":
        # Targets follow from the bin vector, so both splits shrink to weighted vectors.
        table = rows.groupBy("__split", *bins, *metrics).agg(F.count(F.lit(1)).cast("double").alias("__w"))
        table = materialize(table)
        vectors, weight = table.filter("__split = 'train'").select(*bins, *metrics, "__w"), "__w"
    else:
        table, weight = rows, None
        vectors = materialize(compress(rows.filter("__split = 'train'"), bins, metrics))
    return quality, metrics, table, weight, vectors


def evaluate(index: QualityIndex, df: DataFrame) -> DataFrame:
    """(metric, mse, r2, mae, n_samples) of the predictions against the targets of all rows of a table."""
    data = index.encode(clean(df))
    rows, metrics = training_data(data, index.boundaries, index.quality, index.row_model, index.params.target,
                                  null_bin=index.params.null_at)
    # Scored once: the errors take two passes, and the number of rows comes with them.
    scored = materialize(index.model.transform(rows).select(*metrics, *[f"pred_{m}" for m in metrics], F.lit("all").alias("split")))
    n = scored.count()
    out = [(m, mse, r2, mae, n) for _, m, mse, r2, mae in error_rows(scored, metrics)]
    return df.sparkSession.createDataFrame(out, "metric string, mse double, r2 double, mae double, n_samples bigint")


def evaluate_against(index: QualityIndex, df: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same against given true values, matched by key; only metrics both sides know."""
    common = [m for m in index.metrics if m in truth.columns]
    scored = same_keys(index.transform(df).select(*key, *[f"pred_{m}" for m in common]), truth.select(*key, *common), list(key))
    out = [(m, mse, r2, mae) for _, m, mse, r2, mae in error_rows(scored.withColumn("split", F.lit("all")), common)]
    return df.sparkSession.createDataFrame(out, "metric string, mse double, r2 double, mae double")


def result_quality(index: QualityIndex, result: DataFrame) -> DataFrame:
    """One predicted value per metric for any query result."""
    return index.transform(result).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"pred_{m}").alias(m) for m in index.metrics])


def params_dict(params: IndexParams) -> dict:
    return asdict(params)


