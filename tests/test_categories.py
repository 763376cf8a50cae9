"""Text columns as attributes of bins, merges and the index."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import categories as C
from plumbline.operators import discretize as Z
from plumbline.operators import index as I
from plumbline.sources import storage as T

COLS = ["kind", "x", "y"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        kind = None if i % 40 == 0 else "abcdefgh"[int(rng.integers(0, 8))]
        bad = {"a": 0.6, "f": 0.55, "c": 0.3}.get(kind, 0.02)
        rows.append((i, kind, None if rng.random() < bad else float(rng.integers(0, 9)), None if rng.random() < bad else float(i % 5)))
    return spark.createDataFrame(rows, "id int, kind string, x double, y double").repartition(3).persist()


def test_values_are_ordered_by_quality(spark, data):
    pdf = data.toPandas()
    quality = pdf[pdf["kind"].notna()].groupby("kind")[["x", "y"]].apply(lambda g: g.notna().to_numpy().mean())
    codes = {r["value"]: r["code"] for r in C.fit_categories(data, "kind", COLS, {"completeness": 1.0}).collect()}
    order = sorted(quality.index, key=lambda k: (round(quality[k], 9), k))
    assert codes == {k: float(i) for i, k in enumerate(order)} and order[0] in "af"
    got = C.encode(spark.createDataFrame([("a",), (None,), ("new",)], "kind string"), {"kind": C.fit_categories(data, "kind", COLS)}).collect()
    assert [r["kind_code"] is None for r in sorted(got, key=lambda r: str(r["kind"]))] == [True, False, True]


def test_merges_join_the_values_nearest_in_quality(data):
    """Completeness alone: merges follow by hand from the values in order of quality."""
    mapping = C.fit_categories(data, "kind", COLS, {"completeness": 1.0})
    coded = C.encode(data, {"kind": mapping})
    bs = {"kind_code": [float(i) for i in range(9)]}
    h = Z.collect_history(Z.merge_history(coded, bs, COLS, weights={"completeness": 1.0}), bs)["kind_code"]
    pdf = coded.toPandas()
    groups = [g for _, g in pdf[pdf["kind"].notna()].groupby("kind_code")]
    share = lambda g: g[COLS].notna().to_numpy().mean()
    for cost, new in h.merges:
        costs = [len(a) * len(b) / (len(a) + len(b)) * (share(a) - share(b)) ** 2 for a, b in zip(groups, groups[1:])]
        i = int(np.argmin(costs))
        assert cost == pytest.approx(costs[i], abs=1e-12)
        groups[i:i + 2] = [pd.concat(groups[i:i + 2])]
        assert new.n == len(groups[i]) and new.quality["completeness"] == pytest.approx(share(groups[i]))
    # The first bins to be merged are values of like quality: the good ones stay apart from the worst until late.
    left = h.after(5)
    assert len(left) == 3 and {k for k, v in pdf.groupby("kind")["kind_code"].first().items() if v <= left[0].last} <= set("afc")


def test_an_index_over_a_text_column(spark, data, tmp_path):
    params = I.IndexParams(budget=20, n_bins=8, trees=8, depth=6, target="row", null_bin="own", category_weights={"completeness": 1.0},
                           merging="none", min_bins=2)
    index = I.fit_index(data, COLS, params, ["id"])
    assert "kind_code" in index.features and "kind" in index.inputs
    scored = index.transform(data.select("id", *COLS)).toPandas()
    assert list(scored.columns) == ["id", *COLS, *[f"pred_{m}" for m in index.metrics]]
    means = scored.groupby("kind")["pred_row_completeness"].mean()
    assert max(means["a"], means["f"]) < means[["b", "d", "e", "g", "h"]].min()
    assert index.transform(spark.createDataFrame([("new", 1.0, 1.0)], "kind string, x double, y double")).count() == 1
    T.save_index(index, spark, str(tmp_path / "i"))
    again = T.load_index(spark, str(tmp_path / "i"))
    both = again.transform(data).toPandas().sort_values("id")["pred_row_completeness"].to_numpy()
    assert np.allclose(both, scored.sort_values("id")["pred_row_completeness"].to_numpy())
    assert I.evaluate(index, data).count() == 4
