"""The forest against trees grown by hand, its bootstrap, and the paths by aggregate and by task."""

import pickle

import numpy as np
import pytest

from plumbline.operators import forest as R

BINS, TARGETS = ["b0", "b1", "b2"], ["u", "v"]


def rows_of(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, (6, 4, 5), (n, 3))
    x = np.unique(x, axis=0)
    w = rng.integers(1, 9, len(x)).astype(float)
    y = np.stack([np.sin(x[:, 0]) + x[:, 1] * 0.3 + rng.normal(0, 0.1, len(x)), (x[:, 2] > 2) * 2.0 + x[:, 0] * 0.1], axis=1)
    return x, w, y


def brute(x, w, y, depth):
    """A tree as nested tuples: (feature, cut, low, high) or the leaf's means."""
    mean = (w[:, None] * y).sum(0) / w.sum()
    if depth == 0 or np.ptp(y, axis=0).max() <= 1e-12:
        return mean

    def error(k):
        return (w[k][:, None] * (y[k] - (w[k][:, None] * y[k]).sum(0) / w[k].sum()) ** 2).sum()

    best = min(((error(x[:, f] <= c) + error(x[:, f] > c), f, c) for f in range(3) for c in range(6)
                if 0 < (x[:, f] <= c).sum() < len(x)), key=lambda t: (round(t[0], 9), t[1], t[2]), default=None)
    if best is None:
        return mean
    _, f, c = best
    low = x[:, f] <= c
    return f, c, brute(x[low], w[low], y[low], depth - 1), brute(x[~low], w[~low], y[~low], depth - 1)


def look(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def frame(spark, x, w, y):
    return spark.createDataFrame([(*map(int, a), float(b), *map(float, c)) for a, b, c in zip(x, w, y)],
                                 "b0 int, b1 int, b2 int, __w double, u double, v double").repartition(3)


@pytest.mark.parametrize("depth", [1, 3, 20])
def test_a_tree_grows_like_by_hand(depth):
    x, w, y = rows_of()
    got = R.grow(x, w, y, depth, 6)
    one = R.Forest(BINS, TARGETS, np.zeros(1, np.int64), **got)
    tree = brute(x, w, y, depth)
    assert np.allclose(one.predict(x), [look(tree, r) for r in x])


@pytest.mark.parametrize("local", [R.LOCAL, 20])
def test_a_forest_grows_like_by_hand(spark, monkeypatch, local):
    """With a low limit most levels are found by aggregates, with a high one by tasks: the trees are the same."""
    x, w, y = rows_of()
    key = {tuple(a): i for i, a in enumerate(x)}
    df = frame(spark, x, w, y)
    drawn = np.zeros((len(x), 3), np.int64)
    for r in R.with_draws(df, BINS, 3, 7).collect():
        drawn[key[r["b0"], r["b1"], r["b2"]]] = r["__draws"]
    forest = R.fit_forest(df, BINS, TARGETS, 3, 6, 6, seed=7, local=local)
    want = []
    for t in range(3):
        on = drawn[:, t] > 0
        tree = brute(x[on], drawn[on, t].astype(float), y[on], 6)
        want.append([look(tree, r) for r in x])
    assert np.allclose(forest.predict(x), np.mean(want, axis=0))
    assert sum(forest.importances()) == pytest.approx(1) and min(forest.importances()) > 0
    got = {(r["b0"], r["b1"], r["b2"]): (r["pred_u"], r["pred_v"]) for r in forest.transform(df).collect()}
    assert np.allclose([got[tuple(r)] for r in x], np.mean(want, axis=0))


def test_draws_follow_the_number_of_rows():
    """n rows in one vector and n vectors of one row each are drawn by the same law; large counts are not capped."""
    one = R.draws([5], [40.0], 20_000, 1)[0]
    many = R.draws(range(40), [1.0] * 40, 20_000, 1).sum(axis=0)
    for got in (one, many):
        assert got.mean() == pytest.approx(40, abs=0.3) and got.var() == pytest.approx(40, rel=0.06)
    edges = [0, 30, 34, 37, 40, 43, 46, 50, 500]
    a, b = (np.histogram(g, edges)[0] / len(g) for g in (one, many))
    assert np.abs(a - b).max() < 0.02
    big = R.draws([1], [1e9], 500, 1)[0] / 1e9
    assert big.mean() == pytest.approx(1, abs=1e-5) and big.std() == pytest.approx(1e9 ** -0.5, rel=0.2)
    assert (R.draws([3], [2.0], 9, 4) == R.draws([3], [2.0], 9, 4)).all() and not (R.draws([3], [2.0], 9, 4) == R.draws([4], [2.0], 9, 4)).all()


def test_copies_of_all_rows_leave_the_law_unchanged(spark):
    """Sixteen copies of a table keep a vector's relative weight, with less noise."""
    x, w, y = rows_of()
    preds = [R.fit_forest(frame(spark, x, w * k, y), BINS, TARGETS, 30, 4, 6).predict(x) for k in (1, 16)]
    assert np.abs(preds[0] - preds[1]).mean() < 0.1
    whole = R.Forest(BINS, TARGETS, np.zeros(1, np.int64), **R.grow(x, w, y, 4, 6)).predict(x)
    assert np.abs(preds[1] - whole).mean() < np.abs(preds[0] - whole).mean()


def test_edge_cases(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, 0, 1e-9, 2.0, 3.0)], "b0 int, b1 int, b2 int, __w double, u double, v double")
    assert R.fit_forest(one, BINS, TARGETS, 3, 5, 1).predict(np.zeros((2, 3), int)).tolist() == [[2.0, 3.0]] * 2
    x, w, y = rows_of(60)
    forest = R.fit_forest(frame(spark, x, w, y), BINS, TARGETS, 4, 9, 6)
    forest.save(spark, str(tmp_path / "f"))
    again = R.Forest.load(spark, str(tmp_path / "f"))
    assert (again.predict(x) == forest.predict(x)).all() and again.importances() == forest.importances()


def test_a_fitted_forest_stays_out_of_the_driver(spark, tmp_path, monkeypatch):
    """What the driver keeps, and every scoring task is sent, does not grow with the nodes; passes of a few rows score alike."""
    x, w, y = rows_of()
    y = y + np.random.default_rng(1).normal(0, 1, y.shape)
    df = frame(spark, x, w, y)
    forest = R.fit_forest(df, BINS, TARGETS, 40, 20, 6)
    nodes = spark.read.parquet(forest.path).selectExpr("sum(size(feature))").first()[0]
    assert nodes > 3_000 and len(pickle.dumps(forest)) < 10_000
    want = {tuple(r): tuple(p) for r, p in zip(x, forest.predict(x))}
    monkeypatch.setattr(R, "PASS", 7)
    forest.save(spark, str(tmp_path / "f"))
    for one in (forest, R.Forest.load(spark, str(tmp_path / "f"))):
        got = {(r["b0"], r["b1"], r["b2"]): (r["pred_u"], r["pred_v"]) for r in one.transform(df).collect()}
        assert got == want


def test_vectors_travel_packed_per_node():
    x, w, y = rows_of()
    drawn, place = (np.arange(len(x)) % 3).astype(np.int64), np.arange(len(x)) % 4
    got = R._packed(x.astype(np.uint8), y, drawn, place)
    assert list(got["top"]) == [0, 1, 2, 3]
    for r in got.itertuples():
        here = (place == r.top) & (drawn > 0)
        assert np.array_equal(np.frombuffer(r.x, np.uint8).reshape(-1, 3), x[here])
        assert np.array_equal(np.frombuffer(r.y, float).reshape(-1, 2), y[here])
        assert np.array_equal(np.frombuffer(r.w, np.int64), drawn[here])


def test_fewer_trees_are_the_first_ones(spark, tmp_path):
    x, w, y = rows_of()
    df = frame(spark, x, w, y)
    many, few = (R.fit_forest(df, BINS, TARGETS, k, 6, 6) for k in (8, 3))
    assert (many.first(3).predict(x) == few.predict(x)).all() and many.first(3).importances() == few.importances()
    assert many.first(8) is many and not (many.predict(x) == few.predict(x)).all()
    many.first(3).save(spark, str(tmp_path / "f"))
    assert (R.Forest.load(spark, str(tmp_path / "f")).predict(x) == few.predict(x)).all()


def test_a_level_tells_the_sizes_of_the_next(spark, monkeypatch):
    """Nodes are counted once, at the top: the driver starts one aggregate per level after that. Equal targets are not split."""
    x, w, y = rows_of()
    asked, sizes = [], []
    level, count = R._level, R._sizes
    monkeypatch.setattr(R, "_sizes", lambda *a: sizes.append(1) or count(*a))

    def seen(data, bins, targets, tops, wide, n_bins):
        got = level(data, bins, targets, tops, wide, n_bins)
        asked.append((set(wide), got))
        return got
    monkeypatch.setattr(R, "_level", seen)
    R.fit_forest(frame(spark, x, w, y), BINS, TARGETS, 2, 6, 6, local=10)
    assert len(sizes) == 1 and len(asked) > 2
    for (_, found), (wide, _) in zip(asked, asked[1:]):
        assert len(wide) == sum(n > 10 for r in found for n in r[5:])
    asked.clear()
    y[:] = 2.0
    same = R.fit_forest(frame(spark, x, w, y), BINS, TARGETS, 2, 6, 6, local=10)
    assert [len(found) for _, found in asked] == [0] and np.allclose(same.predict(x), 2.0)


def test_one_column_is_scored(spark):
    """A budget may leave room for one column only."""
    x, w, y = rows_of()
    df = frame(spark, x, w, y).groupBy("b0").sum("__w", "u", "v").toDF("b0", "__w", "u", "v")
    forest = R.fit_forest(df, ["b0"], TARGETS, 5, 6, 6)
    got = {r["b0"]: (r["pred_u"], r["pred_v"]) for r in forest.transform(df).collect()}
    want = forest.predict(np.arange(6).reshape(-1, 1))
    assert got == {i: tuple(want[i]) for i in range(6)}
