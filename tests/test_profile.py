import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import correlation as C
from plumbline.operators import drift as D
from plumbline.operators import profile as P
from plumbline.plans.views import load


def col(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"a {kind}")


def test_flags(spark):
    df = col(spark, [1.0, 2.0, None, 3.0, 2.5, 100.0])
    assert [r["a"] for r in P.flag_outliers(df, "a").filter("is_outlier").collect()] == [100.0]
    assert P.flag_outliers(df, "a", "modified_zscore").filter("is_outlier").count() == 1
    assert P.flag_outliers(col(spark, [None, None]), "a").filter("is_outlier").count() == 0
    assert col(spark, [1.0, 2.0, -1.0, 11.0, None]).filter(P.in_range("a", 0, 10)).count() == 2
    words = col(spark, ["a", "b", "x", None], "string")
    assert words.filter(P.in_enum("a", ["a", "b", "c"])).count() == 2
    assert words.filter(P.in_enum("a", ["a", None])).count() == 2


def test_normalize(spark):
    df = col(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    get = lambda m, d=df: [r["normalized"] for r in P.normalize(d, "a", m).orderBy("a").collect()]
    assert get("minmax") == [0, 0.25, 0.5, 0.75, 1]
    z = np.array(get("zscore"))
    assert z.mean() == pytest.approx(0) and z.std(ddof=1) == pytest.approx(1)
    assert get("robust") == [-1, -0.5, 0, 0.5, 1]
    flat = spark.range(100).select(F.lit(0.1).alias("a")).repartition(5)
    assert set(get("minmax", flat)) == {0.5} and set(get("zscore", flat)) == {0.0} and set(get("robust", flat)) == {0.0}


def test_columns(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, None), (1, 4, "x")], "a int, b int, c string")
    assert [r["column"] for r in P.constant_columns(df).collect()] == ["a"]
    assert {r["column"] for r in P.high_cardinality_columns(df).collect()} == {"b"}
    prof = {r["column"]: r for r in P.profile_columns(df).collect()}
    assert prof["c"]["missing_count"] == 1 and prof["c"]["unique_count"] == 2 and prof["c"]["most_common"] == "x"
    num = {r["column"]: r for r in P.profile_numeric(df).collect()}
    assert num["b"]["median"] == 2.5 and num["b"]["kurtosis"] == pytest.approx(-1.2) and num["a"]["skewness"] == 0.0
    freq = P.value_frequency(df, "c").collect()
    assert [(r["value"], r["count"], r["percentage"]) for r in freq] == [("x", 2, 50.0), ("y", 1, 25.0)]


def test_missing(spark):
    df = spark.createDataFrame([(None, None, 1), (1, 1, None), (None, None, 1), (1, 1, None)], "a int, b int, c int")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in P.correlated_missing(df).collect()}
    assert got == {("a", "b"): pytest.approx(1.0), ("a", "c"): pytest.approx(-1.0), ("b", "c"): pytest.approx(-1.0)}
    pats = {tuple(r["pattern"]): r["count"] for r in P.missing_pattern(df).collect()}
    assert pats == {(True, True, False): 2, (False, False, True): 2}


def test_validate_schema(spark):
    df = spark.createDataFrame([(5, "x"), (None, "y")], "age int, tag string")
    got = {(r["category"], r["column"]) for r in P.validate_schema(df, {
        "age": {"type": "int", "min": 6, "max": 10, "required": True}, "name": {"type": "str"}, "tag": {"type": "float"}}).collect()}
    assert got == {("missing_columns", "name"), ("range_errors", "age"), ("missing_required", "age"), ("type_errors", "tag")}


def brute_tau(x, y):
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c, d = c + (a * b > 0), d + (a * b < 0)
        tx, ty = tx + (a == 0), ty + (b == 0)
    n = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((n - tx) * (n - ty))


def test_correlations_against_brute_force(spark, mixed):
    pdf = mixed.select("x", "y", "z").toPandas()
    for method in ("pearson", "spearman", "kendall"):
        got = {(r["column_a"], r["column_b"]): r["correlation"] for r in C.correlation(mixed, method, ["x", "y", "z"]).collect()}
        assert len(got) == 3
        for (a, b), value in got.items():
            both = pdf[[a, b]].dropna()
            if method == "kendall":
                want = brute_tau(both[a].to_numpy(), both[b].to_numpy())
            else:
                r = both.rank() if method == "spearman" else both
                want = np.corrcoef(r[a], r[b])[0, 1]
            assert value == pytest.approx(want, abs=1e-9), (method, a, b)


def test_registered_kendall_on_every_numeric_column(spark, tmp_path):
    from plumbline.plans import QUERIES
    rng = np.random.default_rng(4)
    n = 250
    pdf = pd.DataFrame({c: rng.integers(1, 10 ** 6, n) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}
                       | {c: rng.normal(100, 30, n) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})
    pdf["l_extendedprice"] += pdf["l_quantity"]
    base = spark.createDataFrame(pdf).selectExpr("*", "'A' AS l_returnflag", "'O' AS l_linestatus", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS l_shipdate")
    base.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    view = load(spark, str(tmp_path), "lineitem_q").toPandas()
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in QUERIES["corr_kendall_all"](spark, str(tmp_path)).collect()}
    assert len(got) == 28 and any("l_extendedprice" in k for k in got)
    for (a, b), value in got.items():
        both = view[[a, b]].dropna()
        assert value == pytest.approx(brute_tau(both[a].to_numpy(), both[b].to_numpy()), abs=1e-6), (a, b)


def test_constant_column_has_no_correlation(spark):
    df = spark.range(100).select(F.lit(0.3).alias("a"), F.col("id").alias("b")).repartition(5)
    for method in ("pearson", "spearman", "kendall"):
        assert C.correlation(df, method).first()["correlation"] is None


def test_drift(spark):
    a, b = (spark.createDataFrame([(float(i * 7 % 100 + s), "xy"[i % 2], None) for i in range(200)], "v double, k string, e double") for s in (0, 30))
    ks = D.drift_ks(a, b).collect()
    assert [r["column"] for r in ks] == ["v"] and ks[0]["statistic"] == pytest.approx(0.3) and ks[0]["has_drift"]
    same = D.drift_ks(a, a).first()
    assert same["statistic"] == 0 and same["p_value"] == 1.0
    chi = D.drift_chi2(a, b.union(b), columns=["k"]).first()
    assert chi["statistic"] == pytest.approx(0) and chi["p_value"] == pytest.approx(1.0)
    new = D.drift_chi2(a, b.withColumn("k", F.lit("z")), columns=["k"]).first()
    assert math.isinf(new["statistic"]) and new["p_value"] == 0.0 and new["has_drift"]


def test_chi2_tail():
    # chi-squared with 2 degrees of freedom: exp(-x/2); with 1: erfc(sqrt(x/2))
    for x in (0.1, 1.0, 5.0, 40.0):
        assert D._upper_gamma(1.0, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-5)
        assert D._upper_gamma(0.5, x / 2) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-3)


def test_kendall_over_many_ranges_with_hot_values(spark, monkeypatch):
    """Ranges of a few rows each; one value fills many ranges, and counts weigh the pairs."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, 600).astype(float), rng.integers(0, 9, 600).astype(float)
    x[:250], y[200:400] = 17.0, 4.0
    y[rng.random(600) < 0.1] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": -x + y})).selectExpr("x", "nanvl(y, NULL) AS y", "nanvl(z, NULL) AS z")
    monkeypatch.setattr(C, "RANGE", 25)
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in C.correlation(df, "kendall").collect()}
    pdf = df.toPandas()
    for (a, b), v in got.items():
        u, w = pdf[[a, b]].dropna().to_numpy().T
        du, dw = np.sign(u[:, None] - u), np.sign(w[:, None] - w)
        assert v == pytest.approx((du * dw).sum() / np.sqrt((du ** 2).sum() * (dw ** 2).sum()), abs=1e-12)


def test_spearman_ranks_columns_not_pairs(spark, mixed, monkeypatch):
    """Ranks of a column are shared by its pairs; rows that a partner's missing values take away still count right."""
    seen = []
    whole = C.running_counts
    monkeypatch.setattr(C, "running_counts", lambda counts, *rest: seen.append(counts.count()) or whole(counts, *rest))
    df = mixed.selectExpr("id", "key", "x", "y", "z", "IF(x > 50, y, NULL) AS w", "CAST(NULL AS DOUBLE) AS none", "1 AS one", "IF(x IS NULL, z, NULL) AS other")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in C.correlation(df, "spearman").collect()}
    pdf = df.toPandas()
    names = [c for c in df.columns if c != "none"]
    assert seen == [sum(pdf[c].dropna().nunique() for c in names)]
    assert set(got) == {p for p in itertools.combinations(names, 2) if len(pdf[list(p)].dropna())}
    for (a, b), value in got.items():
        if "one" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(pdf[[a, b]].dropna().rank().corr().iloc[0, 1])
    assert ("x", "other") not in got
    monkeypatch.setattr(C, "SENT", 0)           # all ranks joined by sorting
    assert {(r["column_a"], r["column_b"]): r["correlation"] for r in C.correlation(df, "spearman").collect()} == pytest.approx(got)
    assert C.correlation(df.select("none", "one"), "spearman").count() == 0
    assert C.correlation(df.limit(0), "spearman").count() == 0


@pytest.mark.parametrize("cells, batch", [(2, 50), (7, 10_000)])
def test_kendall_deals_rows_per_column_not_per_pair(spark, monkeypatch, cells, batch):
    """Intervals between cuts hold ties, hot values, infinities, both zeros and NaN, which is the largest value; rows are not multiplied by the pairs."""
    rng = np.random.default_rng(6)
    n = 400
    a, b = rng.normal(0, 5, n), rng.integers(-20, 20, n).astype(float)
    c, d, e = a + 3 * b, rng.choice([-np.inf, -0.0, 0.0, 1.5, np.inf, np.nan], n), rng.integers(0, 10 ** 12, n)
    b[rng.random(n) < 0.3], c[:150] = 4.0, 2.0
    holes = rng.random((n, 5)) < [0.1, 0, 0.2, 0.1, 0]
    rows = [tuple(None if h else (int if i == 4 else float)(v) for i, (v, h) in enumerate(zip(r, hs))) for r, hs in zip(zip(a, b, c, d, e), holes)]
    df = spark.createDataFrame([(*r, None, 7) for r in rows], "a double, b double, c double, d double, e bigint, none double, one int").repartition(3)
    monkeypatch.setattr(C, "CELLS", cells)
    monkeypatch.setattr(C, "RANGE", 200)
    monkeypatch.setattr(C, "BATCH", batch)
    monkeypatch.setattr(C, "HELD", 10 * batch)
    found = C.correlation(df, "kendall")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in found.collect()}
    names = "abcde"
    assert set(got) == {*itertools.combinations(names, 2), *((x, "one") for x in names)}
    for i, j in itertools.combinations(range(5), 2):
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        x, y = (np.unique(v, return_inverse=True)[1].reshape(-1) for v in both.T)
        assert got[names[i], names[j]] == pytest.approx(brute_tau(x, y), abs=1e-12), (names[i], names[j])
    assert all(got[x, "one"] is None for x in names)
    assert C.correlation(df.limit(0), "kendall").count() == 0


def test_kendall_kernels():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        x, y = (rng.integers(0, rng.integers(1, 40), n) for _ in range(2))
        assert C.discordant(x, y) == ((x[:, None] < x) & (y[:, None] > y)).sum()
        keys = rng.choice([C.ABSENT, *rng.integers(-2 ** 63 + 1, 2 ** 63 - 1, 5), *(rng.integers(0, 9, 4) << 40)], n).astype(np.int64)
        assert (C._unpacked(C._packed(keys)) == keys).all()
