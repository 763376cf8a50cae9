"""Any metric per bin and per merged bin, against the metric on the bin's own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import State
from plumbline.operators import binned as N
from plumbline.operators import bins as B
from plumbline.operators import discretize as Z
from plumbline.operators import index as I
from plumbline.operators.metrics import default_catalog


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i * 37 % 101) if i % 11 else None, f"k{i % 40}", None if i % 9 == 0 else "abcdefgh"[: i % 8] + str(i % 3),
             7 if i % 3 == 0 else i, float(i % 17), f"2024-01-{1 + i % 28:02d}") for i in range(600)]
    return spark.createDataFrame(rows, "id int, x double, k string, code string, fk int, y double, day string").repartition(3).persist()


@pytest.fixture(scope="module")
def catalog():
    cat = default_catalog()
    cat.register_state("widest", lambda df, column: State(
        {"lo": F.min(column), "hi": F.max(column)}, lambda s: s("hi") - s("lo"), {"lo": "min", "hi": "max"}), requires_config=True)
    cat.register_aggregate("median_y", lambda df: F.median("y"))
    return cat


@pytest.fixture(scope="module")
def configs(spark):
    ref = spark.createDataFrame([(7,), (10,), (11,), (11,)], "id int")
    truth = spark.createDataFrame([(i, float(i % 5 + 1)) for i in range(0, 600, 2)], "id int, y double")
    return {"format_consistency:pattern": {"column": "code", "pattern": "[a-d]+[01]$"}, "format_consistency": {"column": "code"},
            "constraint_violation": {"constraints": [{"column": "y", "type": "range", "min": 2, "max": 12}, {"column": "k", "type": "enum", "values": ["k1", "k2"]}]},
            "column_completeness": {"column": "code"}, "type_validity": {"expected_types": {"k": "int", "y": "float"}},
            "freshness": {"timestamp_column": "day", "current_time": "2024-02-01 00:00:00"}, "key_uniqueness": {"key_columns": ["k", "fk"]},
            "duplicate_rate": {"subset": ["k"]}, "referential_integrity": {"foreign_key": "fk", "reference": ref},
            "value_accuracy": {"column": "y", "ground_truth": truth, "on": ["id"]}, "completeness": {"columns": ["x", "code"]}, "widest": {"column": "y"}}


def on_rows(df, catalog, configs):
    return {name: catalog.compute(name.split(":")[0], df, **cfg).first()["value"] for name, cfg in configs.items()}


def test_every_bin_equals_the_metric_on_its_rows(data, catalog, configs):
    bs = B.fit_boundaries(data, ["x", "y"], 4)
    both = {**configs, "median_y": {}}
    got = {(r["attr"], r["bin_id"]): r for r in N.bin_metrics(data, bs, both, catalog).collect()}
    binned = B.assign_bins(data, bs, null_bin=None).persist()
    assert len(got) == sum(len(b) - 1 for b in bs.values())
    for (a, b), r in got.items():
        if b in (0, 2):
            for m, v in on_rows(binned.filter(F.col(f"bin_{a}") == b).select(*data.columns), catalog, both).items():
                assert r[m] == pytest.approx(v, rel=1e-9), (a, b, m)


def test_every_union_equals_the_metric_on_its_rows(data, catalog, configs):
    bs = B.fit_boundaries(data, ["x"], 4)
    got = {(r["first"], r["last"], r["metric"]): r["value"] for r in N.union_metrics(data, bs, configs, catalog).collect()}
    binned = B.assign_bins(data, bs, null_bin=None).persist()
    assert len(got) == 10 * len(configs)
    for first, last in ((0, 3), (1, 2), (2, 3), (1, 1)):
        rows = binned.filter(F.col("bin_x").between(first, last)).select(*data.columns)
        for m, v in on_rows(rows, catalog, configs).items():
            assert got[first, last, m] == pytest.approx(v, rel=1e-9), (first, last, m)
    with pytest.raises(ValueError, match="median_y"):
        N.union_metrics(data, bs, {"median_y": {}}, catalog)


def test_merges_follow_and_keep_configured_metrics(data, catalog, configs):
    wanted = {m: configs[m] for m in ("format_consistency:pattern", "constraint_violation", "key_uniqueness")}
    bs = B.fit_boundaries(data, ["x"], 6)
    h = Z.collect_history(Z.merge_history(data, bs, ["x", "y"], weights={"format_consistency:pattern": 1.0}, configs=wanted, catalog=catalog), bs)["x"]
    left = [(b.first, b.last, b.n, b.quality) for b in h.initial]
    for cost, new in h.merges:
        costs = [p[2] * q[2] / (p[2] + q[2]) * (p[3]["format_consistency:pattern"] - q[3]["format_consistency:pattern"]) ** 2 for p, q in zip(left, left[1:])]
        i = int(np.argmin(costs))
        assert cost == pytest.approx(costs[i]) and (new.first, new.last) == (left[i][0], left[i + 1][1])
        left[i:i + 2] = [(new.first, new.last, new.n, new.quality)]
    d = Z.assess("x", h.after(2), 0.0)
    exact = {r["bin_id"]: r["quality"] for r in Z.merged_bin_quality(data, [d], ["x", "y"], wanted, catalog).collect()}
    for i, b in enumerate(d.bins):
        assert {m: b.quality[m] for m in wanted} == pytest.approx({m: exact[i][m] for m in wanted})


def test_an_index_predicts_configured_metrics(data):
    params = I.IndexParams(budget=12, n_bins=4, trees=5, depth=5, configs={"column_completeness": {"column": "code"}},
                           weights={"column_completeness": 1.0}, thresholds={"column_completeness": (0.9, 1.0)})
    index = I.fit_index(data, ["x", "y"], params, ["id"])
    assert "column_completeness" in index.metrics
    assert 0 < index.transform(data).agg(F.avg("pred_column_completeness")).first()[0] < 1
