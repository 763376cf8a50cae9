from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.operators import evaluate as E
from plumbline.operators import index as I
from plumbline.operators import metrics as M
from plumbline.operators import windows as N
from plumbline.sources import storage as T
from plumbline.sources import tables as S
from plumbline.streaming import monitor as O

PARAMS = I.IndexParams(budget=20, n_bins=8, trees=5, depth=6, size_weight="share", target="row", homogeneity="bin")
LIMITS = {"row_completeness": {"warning": 0.99, "critical": 0.7}, "row_consistency": {"warning": 0.6, "critical": 0.3}}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.uniform(0, 100, n), "b": rng.uniform(0, 50, n), "c": rng.uniform(0, 200, n)})
    pdf.loc[pdf["a"] < 30, "b"] = np.where(rng.random((pdf["a"] < 30).sum()) < 0.5, np.nan, 1.0)
    return spark.createDataFrame(pdf).selectExpr("id", "a", "nanvl(b, NULL) AS b", "c").repartition(3).persist()


@pytest.fixture(scope="module")
def index(table):
    return I.fit_index(table, ["a", "b", "c"], PARAMS, ["id"])


def test_index_fits_the_budget_and_predicts(spark, table, index):
    assert 0 < sum(len(q) for q in index.quality.values()) <= 20
    imp = [r["importance"] for r in index.importance(spark).collect()]
    assert sum(imp) == pytest.approx(1.0)
    overall = {(r[0], r[1]): r[3] for r in index.fit_metrics}
    assert overall[("test", "row_completeness")] > 0.3
    rows = index.transform(table, with_bins=True).collect()
    assert len(rows) == 1500 and all(0 <= r["pred_row_completeness"] <= 1.0000001 for r in rows)


def test_distinct_scoring_is_the_same(table, index):
    key = lambda d: {r["id"]: [r[f"pred_{m}"] for m in index.metrics] for r in d.collect()}
    assert key(index.transform(table)) == key(index.transform(table, distinct=True))


def test_missing_feature_column(table, index):
    assert index.transform(table.drop(index.features[0])).count() == 1500


def test_round_trip(spark, table, index, tmp_path):
    T.save_index(index, spark, str(tmp_path / "ix"))
    again = T.load_index(spark, str(tmp_path / "ix"))
    key = lambda i: {r["id"]: r["pred_row_completeness"] for r in i.transform(table).collect()}
    assert key(again) == key(index) and again.params == index.params and again.fit_metrics == index.fit_metrics
    meta = T.save_metadata(index, spark, str(tmp_path / "meta")).first()
    assert meta["selected_features"] == index.features and meta["budget"] == 20
    with pytest.raises(Exception):
        T.load_index(spark, str(tmp_path / "none"))


def test_table_targets_are_the_mean_bin_quality(spark, table):
    ix = I.fit_index(table, ["a", "b", "c"], I.IndexParams(**{**I.params_dict(PARAMS), "target": "table"}), ["id"])
    rows, metrics = I.training_data(table, ix.boundaries, ix.quality, ix.row_model, "table", keep=["id"])
    for r in rows.limit(20).collect():
        for m in metrics:
            want = np.mean([ix.quality[a][r[f"bin_{a}"]][m] for a in ix.features])
            assert r[m] == pytest.approx(want)
    overall = {(r[0], r[1]): r[3] for r in ix.fit_metrics}
    assert overall[("test", "completeness")] > 0.8
    assert I.evaluate(ix, table).filter("metric = 'overall'").first()["n_samples"] == 1500


def test_error_rows_against_numpy(spark):
    rng = np.random.default_rng(2)
    y, p, w = rng.random(50), rng.random(50), rng.integers(1, 5, 50).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"split": "all", "m": y, "pred_m": p, "w": w, "k": 1.0, "pred_k": 1.0}))
    got = {r[1]: r[2:] for r in I.error_rows(df, ["m", "k"], weight="w")}
    mse, mean = np.average((y - p) ** 2, weights=w), np.average(y, weights=w)
    assert got["m"] == pytest.approx((mse, 1 - mse / np.average((y - mean) ** 2, weights=w), np.average(abs(y - p), weights=w)))
    assert got["k"] == (0.0, 1.0, 0.0)


def test_settings_runs(table):
    got = {r["run"]: r for r in E.budget_sweep(table, (6, 20), PARAMS, ["a", "b", "c"], ["id"]).collect()}
    assert got["6"]["n_bins"] <= 6 and got["20"]["n_bins"] <= 20


def test_settings_share_what_is_equal(table, monkeypatch):
    """Fewer trees of the same kind are not grown again, nor is the training table written again; the results are those of single fits."""
    prep = I.prepare(table, ["a", "b", "c"], PARAMS)
    runs = {"few": replace(PARAMS, trees=2), "full": PARAMS, "plain": replace(PARAMS, merging="none")}
    alone = E._row("few", I.fit_index(table, ["a", "b", "c"], runs["few"], ["id"], prep))
    grown, tables, fit, training = [], [], I.fit_forest, I._training
    monkeypatch.setattr(I, "fit_forest", lambda *a: grown.append(a[3:5]) or fit(*a))
    monkeypatch.setattr(I, "_training", lambda *a: tables.append(1) or training(*a))
    got = E.run_settings(table, runs, ["a", "b", "c"], ["id"], prep).collect()
    assert [r["run"] for r in got] == list(runs) and grown == [(5, 6), (5, 6)] and len(tables) == 2
    assert tuple(got[0])[1:] == pytest.approx(alone[1:]) and got[0]["test_mse"] != got[1]["test_mse"]


# -- alerts ----------------------------------------------------------------------------------------

def test_alert_rules(spark):
    scores = spark.createDataFrame([(1, 0.99, 0.01, 0.0), (2, 0.94, 0.07, 0.0), (3, 0.5, 0.2, 0.0)],
                                   "id bigint, pred_completeness double, pred_outlier_rate double, pred_other double")
    found = A.alerts(scores, "id")
    got = {(r["tuple_id"], r["metric"]): (r["severity"], r["threshold"]) for r in found.collect()}
    assert got == {(2, "completeness"): ("warning", 0.95), (2, "outlier_rate"): ("warning", 0.05),
                   (3, "completeness"): ("critical", 0.9), (3, "outlier_rate"): ("critical", 0.1)}
    assert tuple(found.columns) == A.ALERT_COLUMNS
    s = A.alert_statistics(found, 3).first()
    assert (s["n_processed"], s["n_alerts"], s["n_critical"], s["n_warning"]) == (3, 4, 2, 2)
    assert dict(s["alerts_by_metric"]) == {"completeness": 2, "outlier_rate": 2}
    assert A.alert_statistics(found.filter("false"), 3).first()["alert_rate"] == 0.0
    assert A.alerts(scores, "id", {"none": {"warning": 1.0}}).count() == 0
    assert not A.higher_is_better("distribution_skewness") and A.higher_is_better("anything")


def test_log_and_thresholds(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5)], "id bigint, pred_completeness double")
    for _ in range(2):
        T.write_alert_log(A.alerts(scores, "id"), str(tmp_path / "log"))
    log = T.read_alert_log(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.first()["severity"] == "critical"
    (tmp_path / "t.json").write_text('{\n "completeness": {"warning": 0.4},\n "x": {"critical": 1}\n}')
    assert T.load_thresholds(spark, str(tmp_path / "t.json")) == {"completeness": {"warning": 0.4}, "x": {"critical": 1.0}}


def test_reports(spark):
    report = spark.createDataFrame([("completeness", 0.9), ("outlier_rate", 0.2), ("x", 1.0)], "metric string, value double")
    got = {r["metric"]: r["passed"] for r in A.threshold_report(report, {"completeness": 0.9, "outlier_rate": 0.1}).collect()}
    assert got == {"completeness": True, "outlier_rate": False}
    levels = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.5,), (0.1,)], "v double").select(A.quality_level(F.col("v")).alias("l")).collect()
    assert [r["l"] for r in levels] == ["Excellent", "Excellent", "Good", "Fair", "Poor"]


# -- streams -----------------------------------------------------------------------------------------

def test_stream_equals_batch(spark, table, index, tmp_path):
    src = str(tmp_path / "in")
    table.repartition(3).write.parquet(src)
    stream = O.table_stream(spark, src, table.schema, files_per_batch=1)
    O.start_alert_log(O.score_stream(stream, index, "id", LIMITS), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted((r["tuple_id"], r["metric"], r["severity"], round(r["predicted_value"], 9)) for r in d.collect())
    batch = A.alerts(index.transform(table), "id", LIMITS)
    assert key(spark.read.parquet(str(tmp_path / "log"))) == key(batch) and batch.count() > 0
    O.start_monitor(O.table_stream(spark, src, table.schema, files_per_batch=1), index, "id", str(tmp_path / "log2"),
                    str(tmp_path / "sum"), str(tmp_path / "cp2"), LIMITS).awaitTermination()
    sums = spark.read.parquet(str(tmp_path / "sum")).collect()
    assert all(r["seconds"] > 0 and r["rows_per_second"] == pytest.approx(r["n_tuples"] / r["seconds"]) for r in sums)
    assert len(sums) == 3 and sum(r["n_tuples"] for r in sums) == 1500 and sum(r["n_alerts"] for r in sums) == batch.count()


def test_stream_windows_equal_batch(spark, tmp_path):
    df = spark.range(600).selectExpr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts",
                                     "IF(id % 7 = 0, NULL, IF(id % 50 = 1, 1000D, CAST(id % 10 AS DOUBLE))) AS v")
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    limits = M.outlier_limits(df, ["v"])
    stream = O.table_stream(spark, src, df.schema, files_per_batch=1)
    got = O.run_to_table(O.window_metrics(stream, "ts", ["v"], limits, late="40 days"), str(tmp_path / "w"), str(tmp_path / "cp"))
    want = O.window_metrics(df, "ts", ["v"], limits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 25


def test_late_rows_are_dropped_and_state_ends(spark, tmp_path):
    """Ten files of one day each; the last one also holds a row of the first day, which is over by then."""
    src = str(tmp_path / "in")
    schema = "ts timestamp, v double"
    for day in range(10):
        rows = spark.range(20).selectExpr(f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, {day}, CAST(id AS INT)) AS ts", "CAST(id AS DOUBLE) AS v")
        if day == 9:
            rows = rows.unionByName(spark.sql("SELECT TIMESTAMP '2024-01-01 05:00:00' AS ts, 1e9 AS v"))
        rows.coalesce(1).write.mode("append").parquet(src)
    stream = O.table_stream(spark, src, spark.createDataFrame([], schema).schema, files_per_batch=1)
    result = O.window_metrics(stream, "ts", ["v"], {"v": (0.0, 100.0)}, late="1 hour")
    q = O.start_window_log(result, str(tmp_path / "w"), str(tmp_path / "cp"))
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    assert max(states) <= 3 and dropped == 1
    got = O.read_window_log(spark, str(tmp_path / "w"), result.schema).collect()
    assert len(got) == 10 and all(r["n"] == 20 and r["outlier_rate"] == 0 for r in got)
    speeds = O.throughput(q).filter("n_tuples > 0").collect()
    assert len(speeds) == 10 and sum(r["n_tuples"] for r in speeds) == 201 and all(r["rows_per_second"] > 0 for r in speeds)


# -- windows, chunks, sources --------------------------------------------------------------------------

def test_window_quality(spark, mixed, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 200)
    pdf = mixed.select("id", "x", "y").toPandas().sort_values("id").reset_index(drop=True)
    got = {r["id"]: r for r in N.window_quality(mixed, "id", ["x", "y"], 40).collect()}
    assert len(got) == 900
    for i in (0, 5, 19, 20, 199, 200, 201, 450, 880, 899):
        w = pdf.iloc[max(0, i - 20):i + 20][["x", "y"]]
        bad = 0
        for c in ("x", "y"):
            v = w[c].dropna()
            q1, q3 = v.quantile(0.25), v.quantile(0.75)
            bad += int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
        assert got[i]["completeness"] == pytest.approx(w.notna().to_numpy().mean())
        assert got[i]["outlier_rate"] == pytest.approx(bad / w.size)
        assert got[i]["duplicate_rate"] == pytest.approx(w.duplicated().mean())


def test_windows_larger_than_a_block(mixed, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    pdf = mixed.select("id", "key", "z").toPandas().sort_values("id").reset_index(drop=True)
    got = {r["id"]: r for r in N.window_quality(mixed, "id", ["key", "z"], 500).collect()}
    for i in (0, 99, 100, 333, 899):
        w = pdf.iloc[max(0, i - 250):i + 250][["key", "z"]]
        bad = 0
        for c in ("key", "z"):
            q1, q3 = w[c].quantile(0.25), w[c].quantile(0.75)
            bad += int(((w[c] < q1 - 1.5 * (q3 - q1)) | (w[c] > q3 + 1.5 * (q3 - q1))).sum())
        assert got[i]["outlier_rate"] == pytest.approx(bad / w.size) and got[i]["duplicate_rate"] == pytest.approx(w.duplicated().mean())


def test_a_window_of_ten_thousand_rows_slides_once():
    rng = np.random.default_rng(0)
    v = np.where(rng.random(25_000) < 0.1, np.nan, np.exp(rng.normal(0, 1, 25_000)))
    codes = rng.integers(0, 9_000, 25_000)
    out, distinct = N.sliding_outliers(v, 5_000), N.sliding_distinct(codes, 5_000)
    for i in (0, 4_999, 12_345, 24_999):
        w = v[max(0, i - 5_000):i + 5_000]
        w = w[~np.isnan(w)]
        q1, q3 = np.quantile(w, [0.25, 0.75])
        assert out[i] == ((w < q1 - 1.5 * (q3 - q1)) | (w > q3 + 1.5 * (q3 - q1))).sum()
        assert distinct[i] == len(set(codes[max(0, i - 5_000):i + 5_000]))


def test_chunk_means(spark):
    df = spark.range(250).selectExpr("id DIV 10 AS a", "id % 10 AS b", "CAST(id AS DOUBLE) AS q", "CAST(2 * id AS DOUBLE) AS pred_q", "'x' AS chunk").repartition(4)
    got = sorted(map(tuple, N.chunk_means(df, ["a", "b"], ["q"], 100).collect()))
    assert got == [(0, 100, 99.0, 49.5), (1, 100, 299.0, 149.5), (2, 50, 449.0, 224.5)]


def test_chunks(mixed):
    got = N.chunk_quality(mixed, "id", ["x", "y"], 100).collect()
    assert len(got) == 9
    pdf = mixed.select("id", "x", "y").toPandas().sort_values("id")
    for r in got:
        part = pdf.iloc[r["chunk"] * 100:(r["chunk"] + 1) * 100][["x", "y"]]
        assert r["completeness"] == pytest.approx(part.notna().to_numpy().mean())
        assert r["duplicate_rate"] == pytest.approx(part.duplicated().mean())


def test_categories(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "v string")
    rows = I.assign_categories(df, "v", I.category_bins(df, "v", 2), "bin").collect()
    assert sorted((r["v"] or "", r["bin"]) for r in rows) == [("", 0)] + [("a", 1)] * 3 + [("b", 2)] * 2 + [("c", 0)]


def test_every_category_has_a_bin(spark):
    values = [None] * 5 + [f"v{i:03}" for i in range(300) for _ in range(1 + i % 4)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    order = sorted({v for v in values if v}, key=lambda v: (-values.count(v), v))
    bins = I.category_bins(df, "v")
    assert {r["value"]: r["bin_id"] for r in bins.collect()} == {v: i + 1 for i, v in enumerate(order)}
    unseen = df.limit(0).union(spark.createDataFrame([("v000",), ("new",), (None,)], "v string"))
    got = {r["v"]: r["bin"] for r in I.assign_categories(unseen, "v", bins, "bin").collect()}
    assert got == {"v000": order.index("v000") + 1, "new": 0, None: 0}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n3,\n")
    df = S.read_table(spark, str(tmp_path / "t.csv"), "a int, b string")
    assert df.count() == 3 and S.drop_null_rows(df).count() == 1
    assert [f.dataType.simpleString() for f in S.read_csv(spark, str(tmp_path / "t.csv")).schema] == ["int", "string"]
    big = spark.range(1000).repartition(3)
    one, two = (sorted(r["id"] for r in S.sample_rows(big.repartition(k), ["id"], 50).collect()) for k in (1, 5))
    assert one == two and len(one) == 50
    assert [r["id"] for r in S.first_rows(big, ["id"], 3).collect()] == [0, 1, 2]
    assert S.keep_known(df, ["b", "zzz"]).columns == ["b"]


def test_runs_over_sizes_and_settings(table, index):
    cols = [c for c in index.inputs]
    built = E.build_times(table, (200, 400), PARAMS, cols, ["id"]).collect()
    assert [r["rows"] for r in built] == [200, 400] and all(r["seconds"] > 0 for r in built)
    scored = E.batch_times(index, table, (1, 50), ["id"]).collect()
    assert [r["rows"] for r in scored] == [1, 50] and all(r["rows_per_second"] == pytest.approx(r["rows"] / r["seconds"]) for r in scored)
    assert list(E.GRID) == ["baseline", "more_trees", "deeper_trees", "more_bins", "finer_initial", "stricter_merging", "combined"]
