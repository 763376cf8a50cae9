import math

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import MetricSpec
from plumbline.operators import metrics as M


def value(df, name, **cfg):
    return M.measure(name, df, **cfg).first()["value"]


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(spark, values, kind="double", name="a"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_completeness(spark):
    assert value(frame(spark, "a int, b int", (1, 4), (2, 5), (3, 6)), "completeness") == 1.0
    assert value(frame(spark, "a int, b int", (1, 4), (None, 5), (3, 6)), "completeness") == pytest.approx(5 / 6)
    assert value(frame(spark, "a int, b int", (None, None)), "completeness") == 0.0
    assert value(column(spark, []), "completeness") == 1.0
    assert value(column(spark, [1.0, float("nan")]), "completeness") == 0.5
    df = column(spark, [1.0, None, 3.0])
    assert value(df, "column_completeness", column="a") == pytest.approx(2 / 3)
    assert value(df, "column_completeness", column="none") == 1.0


def test_outlier_rate(spark):
    assert value(column(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "outlier_rate") == 0.0
    df = frame(spark, "a double, b int", (1.0, 4), (2.0, 5), (3.0, 6), (100.0, 7))
    assert value(df, "outlier_rate") == 0.125
    assert value(column(spark, ["x", "y"], "string"), "outlier_rate") == 0.0
    assert value(column(spark, []), "outlier_rate") == 0.0
    assert value(column(spark, [1.0, 1.0, 90.0]), "outlier_rate") == 0.0          # fewer than four values
    with pytest.raises(ValueError):
        value(df, "outlier_rate", method="other")


def test_outlier_rate_constant_column_in_partitions(spark):
    df = spark.range(1000).select(F.lit(0.05).alias("c")).repartition(7)
    for method in ("iqr", "zscore", "modified_zscore"):
        assert value(df, "outlier_rate", method=method) == 0.0
    assert value(df, "distribution_skewness") == 0.0
    assert value(df, "distribution_kurtosis") == 0.0


def test_duplicates_and_keys(spark):
    assert value(frame(spark, "a int, b int", (1, 4), (2, 5), (2, 5)), "duplicate_rate") == pytest.approx(1 / 3)
    assert value(frame(spark, "a int, b int", *[(1, 4)] * 3), "duplicate_rate") == pytest.approx(2 / 3)
    df = frame(spark, "a int, b int", (1, 4), (1, 5), (2, 6))
    assert value(df, "duplicate_rate", subset=["a"]) == pytest.approx(1 / 3)
    assert value(column(spark, [None, None], "int"), "duplicate_rate") == 0.5
    assert value(column(spark, []), "duplicate_rate") == 0.0
    ids = column(spark, [1, 2, 2, 3], "int", "id")
    assert value(ids, "key_uniqueness", key_columns=["id"]) == 0.75
    assert value(ids, "key_uniqueness", key_columns=["none"]) == 0.0
    assert value(ids, "key_uniqueness", key_columns=[]) == 1.0


def test_formats_and_references(spark):
    df = column(spark, ["555-1234", "555-5678", "invalid"], "string")
    assert value(df, "format_consistency", column="a", pattern=r"\d{3}-\d{4}") == pytest.approx(2 / 3)
    assert value(column(spark, ["aaaaaaaa"] * 3, "string"), "format_consistency", column="a") == 1.0
    assert value(column(spark, ["x"], "string"), "format_consistency", column="a") == 1.0
    assert value(df, "format_consistency", column="none") == 1.0
    fk, ref = column(spark, [1, 2, 99], "int"), column(spark, [1, 2, 3, 3], "int", "r")
    assert value(fk, "referential_integrity", foreign_key="a", reference=ref) == pytest.approx(2 / 3)
    assert value(column(spark, [None], "int"), "referential_integrity", foreign_key="a", reference=ref) == 1.0


def test_constraints_and_types(spark):
    ages = column(spark, [25, -5, 150, 30], "int")
    assert value(ages, "constraint_violation", constraints=[{"type": "range", "column": "a", "min": 0, "max": 120}]) == 0.5
    words = column(spark, ["active", "invalid", "pending"], "string")
    assert value(words, "constraint_violation", constraints=[{"type": "enum", "column": "a", "values": ["active", "pending"]}]) == pytest.approx(1 / 3)
    xs = column(spark, [10, 20, 5, 30], "int")
    for check in ("a >= 10", lambda c: c >= 10):
        assert value(xs, "constraint_violation", constraints=[{"type": "custom", "column": "a", "check": check}]) == 0.25
    assert value(xs, "constraint_violation", constraints=[{"type": "range", "column": "none", "max": 1}, {"type": "odd", "column": "a"}]) == 0.0
    text = column(spark, ["1", "2.5", "x", "nan", "1d", None, " 3 "], "string")
    assert value(text, "type_validity", expected_types={"a": "int"}) == 0.5
    assert value(text, "type_validity", expected_types={"a": "int"}, strict=True) == pytest.approx(2 / 6)
    assert value(text, "type_validity", expected_types={"a": "str"}) == 1.0
    assert value(column(spark, [0, 1, 2], "int"), "type_validity", expected_types={"a": "bool"}) == pytest.approx(2 / 3)
    assert value(text, "type_validity", expected_types={"none": "int"}) == 1.0


def test_distribution_freshness_accuracy(spark):
    df = column(spark, [1.0, 1.0, 1.0, 2.0, 3.0, 10.0])
    assert value(df, "distribution_skewness") == pytest.approx(1.59556761)
    ts = spark.sql("SELECT TIMESTAMP '2024-01-30 00:00:00' AS t UNION ALL SELECT TIMESTAMP '2024-01-31 00:00:00'")
    assert value(ts, "freshness", timestamp_column="t", current_time="2024-02-01 00:00:00") == pytest.approx(math.exp(-0.05))
    assert value(ts, "freshness", timestamp_column="none") == 0.0
    text = column(spark, ["2024-01-31 00:00:00", "never"], "string")
    assert value(text, "freshness", timestamp_column="a", current_time="2024-02-01 00:00:00") == pytest.approx(math.exp(-1 / 30))
    got = frame(spark, "k int, a double", (1, 10.0), (2, 20.0), (3, 30.0))
    true = frame(spark, "k int, a double", (1, 10.0), (2, 22.0), (3, 31.0))
    assert value(got, "value_accuracy", column="a", ground_truth=true, on=["k"]) == pytest.approx(0.958944, abs=1e-6)
    a, b = (frame(spark, "k int, a string", *enumerate(x)) for x in ("ABCA", "ABCB"))
    assert value(a, "value_accuracy", column="a", ground_truth=b, on=["k"]) == 0.75
    assert value(a, "value_accuracy", column="a", ground_truth=b.filter("k > 9"), on=["k"]) == 0.0


def test_overall_quality_and_report(spark):
    df = frame(spark, "a int, b int", (1, 4), (None, 5), (3, 6))
    assert value(df, "overall_quality", metric_weights={"completeness": 1.0}) == pytest.approx(5 / 6)
    assert value(df, "overall_quality", metric_weights={}) == 1.0
    cat = M.default_catalog()
    assert len(cat) == 14
    report = {r["metric"]: r["value"] for r in cat.compute_all(df, {"column_completeness": {"column": "a"}}).collect()}
    assert set(report) == set(cat.free()) | {"column_completeness"}
    assert report["overall_quality"] == pytest.approx(0.5 * 5 / 6 + 0.5)


def test_report_per_group_equals_single_groups(spark, mixed):
    cat = M.default_catalog()
    df = mixed.drop("id")
    got = {(r["flag"], r["metric"]): r["value"] for r in cat.compute_all(df, keys=["flag"]).collect()}
    for flag in "ab":
        one = df.filter(F.col("flag") == flag).drop("flag")
        for r in cat.compute_all(one).collect():
            assert got[(flag, r["metric"])] == pytest.approx(r["value"], abs=1e-9), (flag, r["metric"])


def test_catalog_rules(spark):
    cat = M.default_catalog()
    with pytest.raises(ValueError):
        cat.register(MetricSpec("completeness", "custom", True, aggregate=M.completeness))
    with pytest.raises(ValueError):
        cat.compute("none", spark.range(1))
    cat.register_aggregate("share_even", lambda df: F.avg((F.col("id") % 2 == 0).cast("double")))

    def broken(df):
        raise RuntimeError("no")
    cat.register_aggregate("broken", broken, higher_is_better=False)
    with pytest.raises(RuntimeError):
        cat.compute_category("custom", spark.range(4))
    got = {r["metric"]: r["value"] for r in cat.compute_category("custom", spark.range(4), on_error="worst").collect()}
    assert got == {"share_even": 0.5, "broken": 1.0}


def test_grouped_pandas_metric(spark):
    import pandas as pd
    from pyspark.sql import types as T

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())
    cat = M.default_catalog()
    udf = F.pandas_udf(spread, T.DoubleType(), F.PandasUDFType.GROUPED_AGG)
    cat.register_aggregate("spread", lambda df: udf(F.col("a")), python=True)
    df = column(spark, [1.0, 4.0, 9.0])
    assert cat.compute_category("custom", df).first()["value"] == 8.0


def test_example_metrics(spark):
    df = frame(spark, "country string, zip_code string", ("US", "12345"), ("US", "67890"), ("CA", "A1B2C3"), ("US", "invalid"), ("CA", "X1Y2Z3"))
    rule = (("country", "zip_code"), "country <> 'US' OR length(zip_code) = 5")
    assert df.agg(M.multi_column_consistency(df, [rule])).first()[0] == 0.8
    people = frame(spark, "age int, status string", (20, "active"), (16, "active"), (None, "active"), (9, "inactive"))
    assert people.agg(M.rule_share(people, "age >= 18", "status = 'active'")).first()[0] == pytest.approx(1 / 3)


def test_a_metric_that_fails_at_run_time_gets_its_worst_value(spark):
    """One failing cast among ten metrics: nine right values, one worst, with and without groups."""
    df = spark.range(60).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id % 10 AS DOUBLE)) AS x", "IF(id = 33, 'bad', CAST(id AS STRING)) AS n", "CAST(id % 3 AS INT) AS g")
    cat = M.default_catalog()
    cat.register_aggregate("mean_of_text", lambda d: F.avg(F.col("n").cast("int")), higher_is_better=False)
    names = ["completeness", "outlier_rate", "mean_of_text", "duplicate_rate", "distribution_skewness", "distribution_kurtosis", "overall_quality",
             "column_completeness", "type_validity", "key_uniqueness"]
    cfg = {"column_completeness": {"column": "x"}, "type_validity": {"expected_types": {"n": "int"}}, "key_uniqueness": {"key_columns": ["id"]}}
    with pytest.raises(Exception):
        cat.compute_wide(df, names, cfg).collect()
    good = [n for n in names if n != "mean_of_text"]
    for keys in ([], ["g"]):
        got = {tuple(r[k] for k in keys): r for r in cat.compute_wide(df, names, cfg, keys, on_error="worst").collect()}
        want = {tuple(r[k] for k in keys): r for r in cat.compute_wide(df, good, cfg, keys).collect()}
        assert got.keys() == want.keys() and len(got) == (3 if keys else 1)
        for k, r in got.items():
            assert r["mean_of_text"] == 1.0 and all(r[n] == pytest.approx(want[k][n]) for n in good)
