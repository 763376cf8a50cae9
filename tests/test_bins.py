import numpy as np
import pandas as pd
import pytest

from plumbline.core import count_rows
from plumbline.functions import quantiles as Q
from plumbline.operators import bins as B
from plumbline.operators import discretize as Z
from plumbline.operators import rows as R
from plumbline.operators import scoring as S
from plumbline.operators import selection as L

COLS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def data(mixed):
    df = mixed.select(*COLS).persist()
    return df, df.toPandas()


def brute_quality(part: pd.DataFrame) -> dict:
    out, shapes = 0, {"s": [], "k": []}
    for c in COLS:
        v = part[c].dropna()
        if len(v) >= 4:
            q1, q3 = v.quantile(0.25), v.quantile(0.75)
            out += int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
        if v.nunique() > 1:
            d = v - v.mean()
            if len(v) >= 3:
                shapes["s"].append(abs((d ** 3).mean() / (d ** 2).mean() ** 1.5))
            if len(v) >= 4:
                shapes["k"].append(abs((d ** 4).mean() / (d ** 2).mean() ** 2 - 3))
    comp, outliers = part.notna().to_numpy().mean(), out / part.size
    return {"completeness": comp, "outlier_rate": outliers, "duplicate_rate": part.duplicated().mean(),
            "distribution_skewness": np.mean(shapes["s"] or [0]), "distribution_kurtosis": np.mean(shapes["k"] or [0]),
            "overall_quality": 0.5 * comp + 0.5 * (1 - outliers)}


def place(v, bs):
    return np.clip(np.searchsorted(bs[1:-1], v, side="right"), 0, len(bs) - 2)


def test_boundaries(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS a", "7.0D AS c", "CAST(NULL AS DOUBLE) AS e", "id % 3 AS few")
    bs = B.fit_boundaries(df, n_bins=10)
    assert len(bs["a"]) == 11 and bs["a"][0] == 0 and bs["a"][-1] == 99
    assert bs["c"] == [7.0, 7.0] and "e" not in bs and len(bs["few"]) <= 4
    rows = B.assign_bins(df, {**bs, "absent": [0.0, 1.0, 2.0]}).collect()
    assert {r["bin_c"] for r in rows} == {0} and {r["bin_absent"] for r in rows} == {0}
    assert [r["bin_a"] for r in sorted(rows, key=lambda r: r["a"])] == [min(i * 10 // 99, 9) for i in range(100)]


def test_lookup_clips_and_places_nulls(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (10.0,), (20.0,), (99.0,), (None,), (float("nan"),)], "a double")
    bs = {"a": [0.0, 10.0, 20.0]}
    assert [r["bin_a"] for r in B.assign_bins(df, bs).collect()] == [0, 0, 1, 1, 1, 0, 0]
    assert [r["bin_a"] for r in B.assign_bins(df, bs, null_bin=None).collect()] == [0, 0, 1, 1, 1, None, None]


def test_bin_quality_against_brute_force(data):
    df, pdf = data
    bs = B.fit_boundaries(df, n_bins=6)
    got = {(r["attr"], r["bin_id"]): r for r in B.bin_quality(df, bs).collect()}
    for a in COLS:
        part = pdf[pdf[a].notna()]
        for b, rows in part.groupby(place(part[a], bs[a])):
            r = got.pop((a, int(b)))
            assert r["n"] == len(rows)
            for m, v in brute_quality(rows[COLS]).items():
                assert r["quality"][m] == pytest.approx(v, abs=1e-9), (a, b, m)
    assert not got


def test_merge_history_against_brute_force(data):
    df, pdf = data
    bs = B.fit_boundaries(df, n_bins=8)
    histories = Z.collect_history(Z.merge_history(df, bs), bs)
    w = 1 / len(B.BIN_METRICS)
    for a in COLS:
        part = pdf[pdf[a].notna()]
        groups = [g[COLS] for _, g in part.groupby(place(part[a], bs[a]))]
        costs = []
        while len(groups) > 1:
            qs = [brute_quality(g) for g in groups]
            cost = [len(g) * len(h) / (len(g) + len(h)) * sum(w * (p[m] - q[m]) ** 2 for m in p)
                    for g, h, p, q in zip(groups, groups[1:], qs, qs[1:])]
            i = int(np.argmin(cost))
            costs.append(cost[i])
            groups[i:i + 2] = [pd.concat(groups[i:i + 2])]
        assert [c for c, _ in histories[a].merges] == pytest.approx(costs, rel=1e-6), a
        last = histories[a].merges[-1][1].quality
        for m, v in brute_quality(part[COLS]).items():
            assert last[m] == pytest.approx(v, abs=1e-9)


def test_thresholds_and_sizes(data, spark):
    df, pdf = data
    bs = B.fit_boundaries(df, n_bins=10)
    for h in Z.collect_history(Z.merge_history(df, bs, size_weight="share"), bs).values():
        counts = [len(h.bins(t)) for t in (0.0, 0.001, 0.01, 0.1, 1e9)]
        assert counts == sorted(counts, reverse=True) and counts[-1] == 1
        assert sum(b.n for b in h.bins(0.01)) == pdf[h.attr].notna().sum()
        d = Z.discretize_adaptive(h)
        assert 1 <= len(d.bins) <= 10 and d.homogeneity >= 0
        assert Z.discretize(h, 0.01, "bin").homogeneity == 0.0


def test_cells_stay_close_on_many_values(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 6000), "b": np.exp(rng.normal(0, 2, 6000))})
    df = spark.createDataFrame(pdf).repartition(4)
    bs = B.fit_boundaries(df, n_bins=5)
    h = Z.collect_history(Z.merge_history(df, bs), bs)
    exact = {(r["attr"], r["bin_id"]): r["quality"] for r in B.bin_quality(df, bs).collect()}
    for a in ("a", "b"):
        for b in h[a].initial:
            q = exact[(a, b.first)]
            assert b.quality["outlier_rate"] == pytest.approx(q["outlier_rate"], abs=0.003)
            assert b.quality["distribution_kurtosis"] == pytest.approx(q["distribution_kurtosis"], rel=1e-6)


def test_merged_bins_are_exact_on_many_values(spark):
    """Every bin of the history, initial or merged, against its rows; one column has a hot value and nulls."""
    rng = np.random.default_rng(11)
    n = 5000
    a, hot = rng.normal(0, 1, n), np.exp(rng.normal(0, 2, n)).round(3)
    hot[::3], hot[1::50] = 2.5, np.nan
    pdf = pd.DataFrame({"a": a, "b": a * 3 + np.exp(rng.normal(0, 2, n)), "c": hot})
    df = spark.createDataFrame(pdf).selectExpr("a", "b", "nanvl(c, NULL) AS c").repartition(4)
    bs = B.fit_boundaries(df, n_bins=6)
    histories = Z.collect_history(Z.merge_history(df, bs), bs)
    for x in "abc":
        part = pdf[pdf[x].notna()]
        at = place(part[x], bs[x])
        for m in [*histories[x].initial, *[m for _, m in histories[x].merges]]:
            rows, out = part[(at >= m.first) & (at <= m.last)], 0
            for c in "abc":
                v = rows[c].dropna()
                q1, q3 = v.quantile(0.25), v.quantile(0.75)
                out += int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
            assert m.n == len(rows) and m.quality["outlier_rate"] == pytest.approx(out / rows.size, abs=1e-12), (x, m.first, m.last)


def test_merge_cost_and_assessment(spark):
    rows = [("a", 0, 0.0, 1.0, 3, {"completeness": 0.9, "outlier_rate": 0.1}), ("a", 1, 1.0, 2.0, 3, {"completeness": 0.92, "outlier_rate": 0.08})]
    bins = spark.createDataFrame(rows, "attr string, bin_id int, lower double, upper double, n bigint, quality map<string,double>")
    got = Z.merge_cost(bins, {"completeness": 0.5, "outlier_rate": 0.5}).collect()
    assert len(got) == 1 and got[0]["cost"] == pytest.approx(0.0006)
    assert Z.separation(bins).first()["separation"] == pytest.approx(0.0002)
    d = Z.Discretization("a", [], 0.005, 0.02, 0.01)
    assert d.acceptable(0.01, 0.01) and not d.acceptable(0.001, 0.01)


def test_row_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, "x"), (2.0, None, None), (None, None, "y"), (3.0, -3.0, "z"), (4.0, 100.0, "x")], "a double, b double, c string")
    m = R.fit_row_metrics(df)
    assert R.RowMetricsModel.from_json(m.to_json()) == m
    rows = [r for r in m.transform(df).collect()]
    assert [r["row_completeness"] for r in rows] == pytest.approx([1, 1 / 3, 1 / 3, 1, 1])
    pdf = df.toPandas()
    num = pdf[["a", "b"]]
    q1, q3 = num.quantile(0.25), num.quantile(0.75)
    inside = ((num >= q1 - 1.5 * (q3 - q1)) & (num <= q3 + 1.5 * (q3 - q1))).sum(axis=1)
    want = (inside / num.notna().sum(axis=1)).fillna(1.0)
    assert [r["row_range_conformance"] for r in rows] == pytest.approx(list(want))
    cvs = [0.0, 96 / 2 / 52]                       # rows 1 and 5; row 4 has mean 0
    t = float(np.median(cvs))
    assert m.typical_cv == pytest.approx(t)
    assert rows[0]["row_consistency"] == pytest.approx(np.exp(-abs(0 - t) / t)) and rows[3]["row_consistency"] == 1.0


def bins_of(spark, spec):
    rows = [(a, i, float(i), float(i + 1), n, {"completeness": c, "outlier_rate": o}) for a, xs in spec.items() for i, (n, c, o) in enumerate(xs)]
    return spark.createDataFrame(rows, "attr string, bin_id int, lower double, upper double, n bigint, quality map<string,double>")


def test_scores(spark):
    assert S.entropy(spark.range(8), "id").first()["entropy"] == pytest.approx(3.0)
    assert S.entropy(spark.range(8).selectExpr("1 AS a"), "a").first()["entropy"] == pytest.approx(0.0, abs=1e-6)
    bins = bins_of(spark, {"p": [(10, 0.98, 0.02), (30, 0.8, 0.15)], "q": [(5, 0.99, 0.0)] * 4})
    limits = {"completeness": (0.95, 1.0), "outlier_rate": (0.0, 0.05), "absent": (0.0, 0.05)}
    assert [r["has_issue"] for r in S.issue_bins(bins, limits).orderBy("attr", "bin_id").collect()] == [False, True, False, False, False, False]
    assert all(r["has_issue"] for r in S.issue_bins(bins, limits, missing="as_one").collect())
    scores = S.feature_scores(bins, {"completeness": 0.5, "outlier_rate": 0.5, "absent": 1.0}, limits, 0.7, 0.3).collect()
    assert [r["attr"] for r in scores] == ["p", "q"]
    assert scores[0]["ig_multi"] == pytest.approx(1.0, abs=1e-6) and scores[0]["qdp"] == pytest.approx(0.75)
    assert scores[0]["importance"] == pytest.approx(0.7 + 0.3 * 0.75, abs=1e-6)
    many = bins_of(spark, {"m": [(1, i / 40, 0.0) for i in range(40)]})
    want = pd.qcut(pd.Series([i / 40 for i in range(40)]), 10, labels=False, duplicates="drop").value_counts(normalize=True)
    got = {r["metric"]: r["ig"] for r in S.information_gain(many).collect()}
    assert got["completeness"] == pytest.approx(-(want * np.log2(want + 1e-10)).sum())


def history(attr, sizes, costs):
    h = Z.MergeHistory(attr, [Z.Bin(i, i, float(i), float(i + 1), n, {"m": i / 10}) for i, n in enumerate(sizes)], [])
    last = 0
    for c in costs:                # merge from the left
        last += 1
        h.merges.append((c, Z.Bin(0, last, 0.0, float(last + 1), sum(sizes[:last + 1]), {"m": 0.5})))
    return h


def test_selection_under_budget():
    hs = {a: history(a, [10] * 8, [0.015] * 3 + [0.5] * 4) for a in "abcd"}
    found = {a: Z.discretize(h, 0.01) for a, h in hs.items()}
    s = L.select_features([(a, 1.0) for a in "abcd"], found, hs, budget=21, min_bins=3)
    assert [(r.attr, r.n_bins, r.adjusted, r.selected) for r in s.rows] == [
        ("a", 8, False, True), ("b", 8, False, True), ("c", 5, True, True), ("d", 8, False, False)]
    assert s.total_bins == 21 and s.utilization == 1.0
    none = L.select_features([(a, 1.0) for a in "abcd"], found, hs, budget=21, min_separation=1e9, max_homogeneity=1.0)
    assert not none.selected
    assert not L.select_features([("a", 1.0)], found, hs, budget=7, adjust=False).selected


def _copies(spark):
    rows = [(None if i % 11 == 0 else float(i % 23), float((i * 37) % 211) + (9000.0 if i % 50 == 0 else 0.0)) for i in range(400)] * 3
    return spark.createDataFrame(rows, "x double, y double").repartition(3)


def test_counted_rows_give_the_same_bins_and_history(spark):
    df = _copies(spark)
    counted = count_rows(df, ["x", "y"])
    assert counted.count() == df.distinct().count() and counted.agg({"__count": "sum"}).first()[0] == 1200
    bs = B.fit_boundaries(df, n_bins=6)
    assert B.fit_boundaries(counted, n_bins=6) == bs
    plain, short = ({(r["attr"], r["bin_id"]): (r["n"], r["quality"]) for r in B.bin_quality(t, bs).collect()} for t in (df, counted))
    pdf = df.toPandas()
    for (a, b), (n, q) in short.items():
        assert plain[a, b][0] == n and plain[a, b][1] == pytest.approx(q)
        lo, hi = bs[a][b], bs[a][b + 1]
        part = pdf[(pdf[a] >= lo) & ((pdf[a] < hi) | (b == len(bs[a]) - 2))]
        skews = [abs(float(((v - v.mean()) ** 3).mean() / ((v - v.mean()) ** 2).mean() ** 1.5)) for v in (part[c].dropna() for c in ("x", "y")) if v.nunique() > 1]
        assert n == len(part) and q["distribution_skewness"] == pytest.approx(np.mean(skews))
    one, two = (Z.collect_history(Z.merge_history(t, bs), bs) for t in (df, counted))
    for a in one:
        assert [c for c, _ in one[a].merges] == pytest.approx([c for c, _ in two[a].merges])
        assert [m.n for _, m in one[a].merges] == [m.n for _, m in two[a].merges]


def test_quartiles_and_boundaries_are_looked_up_together(spark, monkeypatch):
    df = _copies(spark)
    counted, cols, looked = count_rows(df, ["x", "y"]), ["x", "y"], []
    one = Q.counted_quantiles
    monkeypatch.setattr(Q, "counted_quantiles", lambda *a: looked.append(1) or one(*a))
    quartiles, bounds = Q.fit_counted(counted, cols, lambda n: (0.25, 0.75), B.shares(6))
    assert len(looked) == 1 and quartiles == Q.fit_quantiles(counted, cols, (0.25, 0.75))
    assert B.fit_boundaries(counted, cols, 6, bounds) == B.fit_boundaries(df, cols, 6)
    assert R.fit_row_metrics(counted, cols, quartiles=quartiles) == R.fit_row_metrics(counted, cols)


def test_cells_of_many_values_are_fine(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS DOUBLE) AS x", "1L AS __count")
    cells, wide = Z.cell_edges(df, ["x"])
    assert wide == ["x"] and max(b - a for a, b in zip(cells["x"], cells["x"][1:])) < 30
