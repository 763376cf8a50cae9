"""Queries for lookups, training, the index, monitoring and evaluation."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from ..core import clean, shared_dir, spread
from ..operators import alerts as A
from ..operators import bins as B
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import metrics as M
from ..operators import windows as N
from ..sources import storage as T
from ..streaming import monitor as O
from .bin_queries import BIN_WEIGHTS, LIMITS, QUALITY, all_bins, lines, measures, place
from .metric_queries import EV, LI, OR, REPORT_SQL
from .registry import query, rounded
from .views import FEATURES, VIEWS, load

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
# Budget, bins, trees and depth are the defaults of the entry: 100, 30, 100, 20.
SETTINGS = I.IndexParams(weights=BIN_WEIGHTS, thresholds=LIMITS, size_weight="share")
ROW_SETTINGS = replace(SETTINGS, target="row", size_weight="rows", null_bin="own")
ROW_ALERTS = {"row_completeness": {"warning": 0.9, "critical": 0.7}, "row_range_conformance": {"warning": 0.95, "critical": 0.8},
              "row_consistency": {"warning": 0.8, "critical": 0.5}}
BIN_ALERTS = {"completeness": {"warning": 0.965, "critical": 0.955}, "outlier_rate": {"warning": 0.002, "critical": 0.004},
              "overall_quality": {"warning": 0.99, "critical": 0.98}}

_prepared: dict = {}
_indexes: dict = {}


def prepared(spark, sf, params=SETTINGS):
    """Fits are shared by the queries of a session."""
    at = (spark.sparkContext.applicationId, sf, repr(params))
    if at not in _prepared:
        _prepared[at] = I.prepare(lines(spark, sf), FEATURES, params)
    return _prepared[at]


def fitted(spark, sf, params=SETTINGS):
    at = (spark.sparkContext.applicationId, sf, repr(params))
    if at not in _indexes:
        _indexes[at] = I.fit_index(lines(spark, sf), FEATURES, params, KEY, prepared(spark, sf, params))
    return _indexes[at]


# -- lookup and training data ------------------------------------------------------------------------

_dense = "qd AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY bin_id) - 1 AS id FROM q), fb AS (SELECT attr, list_sort(list(lower)) || [max(upper)] AS bs FROM q GROUP BY attr)"
_vec = ", ".join(f"CASE WHEN {a} IS NULL THEN 0 ELSE (SELECT {place(a)} FROM fb WHERE attr = '{a}') END AS bin_{a}" for a in FEATURES)
VECTORS = f"{_dense}, r0 AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity AS qty, {_vec} FROM lineitem_q)"
_joins = " ".join(f"JOIN qd AS d{i} ON d{i}.attr = '{a}' AND d{i}.id = bin_{a}" for i, a in enumerate(FEATURES))
LOOKUP = (f"{VECTORS}, lk AS (SELECT l_orderkey, r0.l_linenumber, l_partkey, {', '.join(f'bin_{a}' for a in FEATURES)}, "
          + ", ".join(f"({' + '.join(f'd{i}.{m}' for i in range(len(FEATURES)))}) / {len(FEATURES)} AS {m}" for m in B.BIN_METRICS)
          + f" FROM r0 {_joins})")
_bins_out = ", ".join(f"CAST(bin_{a} AS BIGINT) AS bin_{a}" for a in FEATURES)
_metrics_out = ", ".join(f"round({m}, 6) AS {m}" for m in B.BIN_METRICS)


def dictionary(spark, sf):
    """Boundaries and bin quality of the unmerged bins."""
    bins = all_bins(spark, sf)
    bs = B.boundaries_of(bins)
    quality = I.quality_of(bins)
    return {a: bs[a] for a in FEATURES}, {a: quality[a] for a in FEATURES}


@query("bin_lookup", f"{LI}, {QUALITY}, {VECTORS} SELECT l_orderkey, l_linenumber, l_partkey, round(qty, 6) AS l_quantity, CAST(bin_l_quantity AS BIGINT) AS bin_l_quantity FROM r0")
def _(spark, sf):
    bs, _ = dictionary(spark, sf)
    rows = B.assign_bins(lines(spark, sf), {"l_quantity": bs["l_quantity"]})
    return rounded(rows.select(*KEY, "l_quantity", "bin_l_quantity"))


@query("bin_vectors", f"{LI}, {QUALITY}, {VECTORS} SELECT l_orderkey, l_linenumber, l_partkey, {_bins_out} FROM r0")
def _(spark, sf):
    bs, _ = dictionary(spark, sf)
    return rounded(B.assign_bins(lines(spark, sf), bs).select(*KEY, *[f"bin_{a}" for a in FEATURES]))


@query("bin_vectors_categorical", f"{OR}, t AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS b FROM orders_q WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY b LIMIT 3) "
       "SELECT o_orderkey, o_orderpriority, coalesce(b, 0) AS bin_id FROM orders_q LEFT JOIN t ON o_orderpriority = v")
def _(spark, sf):
    """Shows the three most common values by design; the other values share bin 0. The index uses the whole operator."""
    df = load(spark, sf, "orders_q").select("o_orderkey", "o_orderpriority")
    return rounded(I.assign_categories(df, "o_orderpriority", I.category_bins(df, "o_orderpriority", 3), "bin_id"))


@query("bin_vectors_categorical_all", f"{OR}, t AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS b FROM orders_q WHERE o_orderpriority IS NOT NULL GROUP BY 1) "
       "SELECT o_orderkey, o_orderpriority, coalesce(b, 0) AS bin_id FROM orders_q LEFT JOIN t ON o_orderpriority = v")
def _(spark, sf):
    df = load(spark, sf, "orders_q").select("o_orderkey", "o_orderpriority")
    return rounded(I.assign_categories(df, "o_orderpriority", I.category_bins(df, "o_orderpriority"), "bin_id"))


@query("bin_quality_lookup", f"{LI}, {QUALITY}, {LOOKUP} SELECT l_orderkey, l_linenumber, l_partkey, {_metrics_out} FROM lk")
def _(spark, sf):
    bs, quality = dictionary(spark, sf)
    rows = I.lookup_quality(B.assign_bins(clean(lines(spark, sf)), bs), quality, B.BIN_METRICS)
    return rounded(rows.select(*KEY, *B.BIN_METRICS))


@query("training_data", f"{LI}, {QUALITY}, {LOOKUP} SELECT l_orderkey, l_linenumber, l_partkey, {_bins_out}, {_metrics_out} FROM lk")
def _(spark, sf):
    bs, quality = dictionary(spark, sf)
    return rounded(I.training_data(lines(spark, sf), bs, quality, None, keep=KEY)[0])


@query("bin_occupancy", f"{LI}, {QUALITY}, {VECTORS}, o AS (" + " UNION ALL ".join(f"SELECT '{a}' AS attr, CAST(bin_{a} AS BIGINT) AS bin_id FROM r0" for a in FEATURES)
       + ") SELECT attr, bin_id, count(*) AS n FROM o GROUP BY ALL")
def _(spark, sf):
    bs, _ = dictionary(spark, sf)
    return rounded(I.bin_occupancy(B.assign_bins(lines(spark, sf), bs), FEATURES))


@query("training_roundtrip", f"{LI}, {QUALITY}, {LOOKUP} SELECT l_orderkey, l_linenumber, l_partkey, {_bins_out}, {_metrics_out} FROM lk")
def _(spark, sf):
    bs, quality = dictionary(spark, sf)
    path = shared_dir(spark, "training")
    T.save_training_data(I.training_data(lines(spark, sf), bs, quality, None, keep=KEY)[0], path)
    return rounded(T.load_training_data(spark, path))


# -- the index -----------------------------------------------------------------------------------------

@query("entry_index")
def _(spark, sf):
    index = fitted(spark, sf)
    rows = [(a, len(index.quality[a]), list(index.boundaries[a])) for a in index.features]
    return spark.createDataFrame(rows, "attr string, n_bins int, boundaries array<double>")


@query("index_fit_metrics")
def _(spark, sf):
    return rounded(fitted(spark, sf).metrics_frame(spark))


@query("index_row_targets")
def _(spark, sf):
    return rounded(fitted(spark, sf, ROW_SETTINGS).metrics_frame(spark))


@query("feature_importance")
def _(spark, sf):
    return rounded(fitted(spark, sf).importance(spark))


@query("score_batch")
def _(spark, sf):
    index = fitted(spark, sf, ROW_SETTINGS)
    return rounded(index.transform(spread(lines(spark, sf).select(*dict.fromkeys([*KEY, *index.features])))))


@query("score_with_bins")
def _(spark, sf):
    index = fitted(spark, sf, ROW_SETTINGS)
    rows = spread(lines(spark, sf).select(*dict.fromkeys([*KEY, *index.features])))
    return rounded(index.transform(rows, with_bins=True, distinct=True))


@query("index_evaluate")
def _(spark, sf):
    return rounded(I.evaluate(fitted(spark, sf), lines(spark, sf)))


@query("eval_accuracy")
def _(spark, sf):
    return rounded(I.evaluate(fitted(spark, sf, ROW_SETTINGS), lines(spark, sf)))


@query("index_roundtrip")
def _(spark, sf):
    index, path = fitted(spark, sf, ROW_SETTINGS), shared_dir(spark, "index")
    T.save_index(index, spark, path)
    again = T.load_index(spark, path)
    rows = spread(lines(spark, sf).select(*dict.fromkeys([*KEY, *index.features])))
    return rounded(again.transform(rows))


@query("index_metadata")
def _(spark, sf):
    return rounded(T.save_metadata(fitted(spark, sf), spark, shared_dir(spark, "metadata")).drop("build_time"))


@query("result_quality")
def _(spark, sf):
    return rounded(I.result_quality(fitted(spark, sf, ROW_SETTINGS), lines(spark, sf).filter("l_linestatus = 'O'")))


# -- alerts ----------------------------------------------------------------------------------------------

TUPLE_SQL = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


def tuple_id():
    """The whole key: lines of one order share its number."""
    return F.concat_ws("-", *KEY)


def _alert_sql(m, limits):
    op = "<" if A.higher_is_better(m) else ">"
    c, w = limits["critical"], limits["warning"]
    return (f"SELECT {TUPLE_SQL} AS tuple_id, '{m}' AS metric, round({m}, 6) AS predicted_value, CASE WHEN {m} {op} {c} THEN CAST({c} AS DOUBLE) ELSE CAST({w} AS DOUBLE) END AS threshold, "
            f"CASE WHEN {m} {op} {c} THEN 'critical' ELSE 'warning' END AS severity FROM lk WHERE {m} {op} {c} OR {m} {op} {w}")


ALERTS = f"{LOOKUP}, al AS (" + " UNION ALL ".join(_alert_sql(m, x) for m, x in BIN_ALERTS.items()) + ")"


def given_scores(spark, sf):
    bs, quality = dictionary(spark, sf)
    rows = I.lookup_quality(B.assign_bins(clean(lines(spark, sf)), bs), quality, B.BIN_METRICS)
    return rows.select(*KEY, *[F.col(m).alias(f"pred_{m}") for m in B.BIN_METRICS])


@query("alerts_from_scores", f"{LI}, {QUALITY}, {ALERTS} SELECT * FROM al")
def _(spark, sf):
    return rounded(A.alerts(given_scores(spark, sf), tuple_id(), BIN_ALERTS).drop("ts"))


@query("alert_statistics", f"{LI}, {QUALITY}, {ALERTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lk) SELECT CAST(n AS BIGINT) AS n_processed, count(*) AS n_alerts, round(count(*) / n, 6) AS alert_rate, "
       "count(CASE WHEN severity = 'critical' THEN 1 END) AS n_critical, count(CASE WHEN severity = 'warning' THEN 1 END) AS n_warning FROM al, n GROUP BY n")
def _(spark, sf):
    scores = given_scores(spark, sf)
    return rounded(A.alert_statistics(A.alerts(scores, tuple_id(), BIN_ALERTS), scores).drop("alerts_by_metric"))


@query("alerts_by_metric", f"{LI}, {QUALITY}, {ALERTS} SELECT metric, count(*) AS n FROM al GROUP BY metric")
def _(spark, sf):
    scores = given_scores(spark, sf)
    stats = A.alert_statistics(A.alerts(scores, tuple_id(), BIN_ALERTS), scores)
    return stats.select(F.explode("alerts_by_metric").alias("metric", "n"))


@query("alert_log_given_scores", f"{LI}, {QUALITY}, {ALERTS} SELECT * FROM al")
def _(spark, sf):
    """Alerts on given scores, written as CSV with thresholds read from a file, and read back."""
    limits, log = shared_dir(spark, "thresholds"), shared_dir(spark, "alerts")
    spark.createDataFrame([(json.dumps(BIN_ALERTS),)], "value string").coalesce(1).write.text(limits)
    T.write_alert_log(A.alerts(given_scores(spark, sf), tuple_id(), T.load_thresholds(spark, limits)), log)
    return rounded(T.read_alert_log(spark, log, key_type="string").drop("ts"))


@query("alert_summary_given_scores", f"{LI}, {QUALITY}, {ALERTS}, n AS (SELECT count(*) AS n FROM lk) SELECT n AS n_tuples, count(*) AS n_alerts, round(CAST(count(*) AS DOUBLE) / n, 6) AS alert_rate FROM al, n GROUP BY n")
def _(spark, sf):
    """What the monitor keeps of a batch, for all rows as one batch with given scores."""
    scores = given_scores(spark, sf)
    return rounded(O.batch_summary(A.alerts(scores, tuple_id(), BIN_ALERTS), scores.count()))


def row_scores(spark, sf):
    index = fitted(spark, sf, ROW_SETTINGS)
    return index.transform(spread(lines(spark, sf).select(*dict.fromkeys([*KEY, *index.features]))))


@query("alerts_batch")
def _(spark, sf):
    return rounded(A.alerts(row_scores(spark, sf), tuple_id(), ROW_ALERTS).drop("ts"))


@query("alerts_default_thresholds", f"{LI}, {QUALITY}, {LOOKUP}, al AS ("
       + " UNION ALL ".join(_alert_sql(m, x) for m, x in A.ALERT_THRESHOLDS.items() if m in B.BIN_METRICS) + ") SELECT * FROM al")
def _(spark, sf):
    """Given scores against the default limits."""
    return rounded(A.alerts(given_scores(spark, sf), tuple_id()).drop("ts"))


@query("alerts_custom_thresholds")
def _(spark, sf):
    path = shared_dir(spark, "thresholds")
    spark.createDataFrame([(json.dumps(ROW_ALERTS),)], "value string").coalesce(1).write.text(path)
    return rounded(A.alerts(row_scores(spark, sf), tuple_id(), T.load_thresholds(spark, path)).drop("ts"))


@query("alert_log")
def _(spark, sf):
    path = shared_dir(spark, "alerts")
    T.write_alert_log(A.alerts(row_scores(spark, sf), tuple_id(), ROW_ALERTS), path)
    return rounded(T.read_alert_log(spark, path, key_type="string").drop("ts"))


def line_stream(spark, sf):
    base = load(spark, sf, "lineitem")
    raw = O.table_stream(spark, sf, base.schema, files="lineitem.parquet")
    return raw.selectExpr(*_select_list("lineitem_q")).withColumn("tuple", tuple_id())


def _select_list(view):
    """The view's select list as separate expressions (it has no commas inside parentheses at top level)."""
    out, depth, cur = [], 0, ""
    for ch in VIEWS[view][1]:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


@query("stream_alerts")
def _(spark, sf):
    log, mark = shared_dir(spark, "stream-alerts"), shared_dir(spark, "stream-mark")
    found = O.score_stream(line_stream(spark, sf), fitted(spark, sf, ROW_SETTINGS), "tuple", ROW_ALERTS,
                           partitions=spark.sparkContext.defaultParallelism)
    O.start_alert_log(found, log, mark).awaitTermination()
    return rounded(spark.read.schema(found.schema).parquet(log).drop("ts"))


@query("alert_batch_summary")
def _(spark, sf):
    log, sums, mark = (shared_dir(spark, x) for x in ("monitor-alerts", "monitor-summaries", "monitor-mark"))
    O.start_monitor(line_stream(spark, sf), fitted(spark, sf, ROW_SETTINGS), "tuple", log, sums, mark, ROW_ALERTS).awaitTermination()
    return rounded(spark.read.parquet(sums).drop("id"))


# -- windows, chunks, reports ------------------------------------------------------------------------------

@query("stream_window_quality", f"{EV}, s AS (SELECT quantile_cont(value, .25) AS a, quantile_cont(value, .75) AS b FROM events_q) "
       "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(CAST(count(user_id) + count(value) AS DOUBLE) / (count(*) * 2), 6) AS completeness, "
       "round(CAST(count(CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 1 END) AS DOUBLE) / count(*), 6) AS outlier_rate FROM events_q, s GROUP BY ALL")
def _(spark, sf):
    history = load(spark, sf, "events_q")
    limits = M.outlier_limits(history, ["value"])
    raw = O.table_stream(spark, sf, load(spark, sf, "events").schema, files="events.parquet")
    stream = raw.selectExpr(*_select_list("events_q"))
    result = O.window_metrics(stream, "ts", ["user_id", "value"], limits, keys=["event_type"])
    table = O.run_to_table(result, shared_dir(spark, "windows"), shared_dir(spark, "windows-mark"), ["event_type"])
    return rounded(table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("threshold_report", REPORT_SQL.replace(" SELECT 'completeness' AS metric", " SELECT metric, value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN up THEN value >= threshold ELSE value <= threshold END AS passed FROM (SELECT 'completeness' AS metric", 1)
       + ") JOIN (VALUES ('completeness', 0.95, true), ('outlier_rate', 0.05, false), ('duplicate_rate', 0.0, false), ('overall_quality', 0.99, true)) AS t(metric2, threshold, up) ON metric = metric2")
def _(spark, sf):
    report = M.default_catalog().compute_all(lines(spark, sf))
    return rounded(A.threshold_report(report, {"completeness": 0.95, "outlier_rate": 0.05, "duplicate_rate": 0.0, "overall_quality": 0.99}))


@query("quality_level", f"{LI}, {QUALITY} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(completeness, 6) AS completeness, CASE WHEN completeness >= .9 THEN 'Excellent' WHEN completeness >= .7 THEN 'Good' WHEN completeness >= .5 THEN 'Fair' ELSE 'Poor' END AS level FROM q")
def _(spark, sf):
    bins = all_bins(spark, sf).select("attr", "bin_id", F.col("quality")["completeness"].alias("completeness"))
    return rounded(bins.withColumn("level", A.quality_level(F.col("completeness"))))


WINDOW_COLS = ["o_custkey", "o_totalprice", "o_orderpriority"]


def _window_sql(cols):
    return " + ".join(f"len(list_filter(l_{c}, lambda x: x < list_aggregate(l_{c}, 'quantile_cont', .25) - 1.5 * (list_aggregate(l_{c}, 'quantile_cont', .75) - list_aggregate(l_{c}, 'quantile_cont', .25)) "
                      f"OR x > list_aggregate(l_{c}, 'quantile_cont', .75) + 1.5 * (list_aggregate(l_{c}, 'quantile_cont', .75) - list_aggregate(l_{c}, 'quantile_cont', .25))))" for c in cols)


query("window_quality", f"{OR}, w AS (SELECT o_orderkey, count(*) OVER f AS n, count(o_custkey) OVER f + count(o_totalprice) OVER f + count(o_orderpriority) OVER f AS filled, "
      "count(DISTINCT (o_custkey, o_totalprice, o_orderpriority)) OVER f AS different, list(CAST(o_custkey AS DOUBLE)) FILTER (WHERE o_custkey IS NOT NULL) OVER f AS l_o_custkey, list(o_totalprice) FILTER (WHERE o_totalprice IS NOT NULL) OVER f AS l_o_totalprice "
      "FROM orders_q WINDOW f AS (ORDER BY o_orderkey ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)) "
      f"SELECT o_orderkey, round(CAST(filled AS DOUBLE) / (n * 3), 6) AS completeness, round(CAST({_window_sql(['o_custkey', 'o_totalprice'])} AS DOUBLE) / (n * 2), 6) AS outlier_rate, "
      "round(1 - CAST(different AS DOUBLE) / n, 6) AS duplicate_rate FROM w")(
    lambda spark, sf: rounded(N.window_quality(load(spark, sf, "orders_q"), "o_orderkey", WINDOW_COLS, 100)))
query("chunk_quality", f"{OR}, k AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS chunk FROM orders_q), "
      "s AS (SELECT chunk AS sc, quantile_cont(CAST(o_custkey AS DOUBLE), .25) AS a1, quantile_cont(CAST(o_custkey AS DOUBLE), .75) AS b1, quantile_cont(o_totalprice, .25) AS a2, quantile_cont(o_totalprice, .75) AS b2 FROM k GROUP BY chunk) "
      "SELECT chunk, round(CAST(count(o_custkey) + count(o_totalprice) + count(o_orderpriority) AS DOUBLE) / (count(*) * 3), 6) AS completeness, "
      "round(CAST(count(CASE WHEN o_custkey < a1 - 1.5 * (b1 - a1) OR o_custkey > b1 + 1.5 * (b1 - a1) THEN 1 END) + count(CASE WHEN o_totalprice < a2 - 1.5 * (b2 - a2) OR o_totalprice > b2 + 1.5 * (b2 - a2) THEN 1 END) AS DOUBLE) / (count(*) * 2), 6) AS outlier_rate, "
      "round(1 - CAST(count(DISTINCT (o_custkey, o_totalprice, o_orderpriority)) AS DOUBLE) / count(*), 6) AS duplicate_rate FROM k JOIN s ON chunk = sc GROUP BY chunk")(
    lambda spark, sf: rounded(N.chunk_quality(load(spark, sf, "orders_q"), "o_orderkey", WINDOW_COLS, 100)))


# The lookup with what a row's own completeness is; the order below tells all rows apart.
_truth = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in FEATURES)
JUDGED = LOOKUP.replace("l_quantity AS qty,", f"l_quantity AS qty, l_suppkey, l_extendedprice, ({_truth}) / CAST({len(FEATURES)} AS DOUBLE) AS truth,").replace(
    "lk AS (SELECT l_orderkey,", "lk AS (SELECT l_suppkey, l_extendedprice, truth, l_orderkey,")
ROW_ORDER = [*KEY, "l_suppkey", "l_extendedprice"]


def judged_scores(spark, sf):
    """Rows with their bins' mean completeness as prediction and their own completeness as truth."""
    bs, quality = dictionary(spark, sf)
    rows = I.lookup_quality(B.assign_bins(clean(lines(spark, sf)), bs), quality, ["completeness"])
    truth = sum((F.col(c).isNotNull().cast("int") for c in FEATURES), F.lit(0)) / F.lit(float(len(FEATURES)))
    return rows.select(*ROW_ORDER, F.col("completeness").alias("pred_completeness"), truth.alias("completeness"))


@query("chunk_predictions", f"{LI}, {QUALITY}, {JUDGED}, k AS (SELECT completeness AS pred, truth, CAST(floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / 1000) AS BIGINT) AS chunk FROM lk) "
       "SELECT chunk, count(*) AS n, round(avg(pred), 6) AS predicted_completeness, round(avg(truth), 6) AS true_completeness FROM k GROUP BY chunk")
def _(spark, sf):
    """Predicted against true completeness per 1,000 rows."""
    return rounded(N.chunk_means(judged_scores(spark, sf), ROW_ORDER, ["completeness"], 1000))


@query("errors_of_given_scores", f"{LI}, {QUALITY}, {JUDGED}, m AS (SELECT avg(truth) AS m FROM lk) SELECT 'completeness' AS metric, round(avg(power(completeness - truth, 2)), 6) AS mse, "
       "round(1 - avg(power(completeness - truth, 2)) / avg(power(truth - m, 2)), 6) AS r2, round(avg(abs(completeness - truth)), 6) AS mae FROM lk, m")
def _(spark, sf):
    """The error metrics of an evaluation, on given predictions."""
    scored = judged_scores(spark, sf).withColumn("split", F.lit("all"))
    rows = [r[1:] for r in I.error_rows(scored, ["completeness"]) if r[1] != "overall"]
    return rounded(spark.createDataFrame(rows, "metric string, mse double, r2 double, mae double"))

# -- evaluation --------------------------------------------------------------------------------------------

@query("eval_discretization")
def _(spark, sf):
    return rounded(E.discretization_variants(spark, prepared(spark, sf)))


@query("eval_budget")
def _(spark, sf):
    return rounded(E.budget_sweep(lines(spark, sf), (10, 25, 50, 100, 200), ROW_SETTINGS, FEATURES, KEY, prepared(spark, sf, ROW_SETTINGS)))


@query("eval_ablation")
def _(spark, sf):
    return rounded(E.ablation(lines(spark, sf), ROW_SETTINGS, FEATURES, KEY, prepared(spark, sf, ROW_SETTINGS)))


@query("eval_settings")
def _(spark, sf):
    """The seven settings of the accuracy study."""
    return rounded(E.settings_grid(spread(lines(spark, sf)), ROW_SETTINGS, FEATURES, KEY))


@query("index_evaluate_against")
def _(spark, sf):
    """Predictions against a table of true row metrics, matched by key."""
    index = fitted(spark, sf, ROW_SETTINGS)
    truth = index.row_model.transform(lines(spark, sf)).select(*KEY, *index.metrics)
    return rounded(I.evaluate_against(index, lines(spark, sf), truth, KEY))
