import numpy as np
import pandas as pd
import pytest

from plumbline.functions import quantiles as Q
from plumbline.functions.positions import with_position

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({"g": rng.choice([1, 1, 1, 2, 3], n), "u": rng.normal(0, 100, n), "t": rng.integers(0, 7, n).astype(float),
                        "s": np.exp(rng.normal(0, 3, n))})
    pdf.loc[::9, "u"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("CAST(g AS INT) AS g", "nanvl(u, NULL) AS u", "t", "s").repartition(5).persist()
    return pdf, df


@pytest.mark.parametrize("error", [None, 0.0026])
def test_fit_quantiles_exact_whatever_the_intervals(numbers, monkeypatch, error):
    if error:
        # Intervals that are mostly wrong: a sketch of few entries, with the allowance of a large one.
        monkeypatch.setattr(Q, "rank_error", lambda k: error)
        monkeypatch.setattr(Q, "sketched", lambda df, columns, keys, k, f=Q.sketched: f(df, columns, keys, 8))
    pdf, df = numbers
    got = Q.fit_quantiles(df, ["u", "t", "s"], PROBS)
    for c in ("u", "t", "s"):
        assert got[c] == pytest.approx(list(pdf[c].quantile(list(PROBS))), rel=1e-12, abs=1e-12)
    many = Q.fit_quantiles(df, ["u", "t"], lambda n: [i / 20 for i in range(21)])
    for c in many:
        assert many[c] == pytest.approx(list(pdf[c].quantile([i / 20 for i in range(21)])), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("error", [None, 0.0026])
def test_grouped_quantiles_exact_whatever_the_intervals(numbers, monkeypatch, error):
    if error:
        monkeypatch.setattr(Q, "rank_error", lambda k: error)
        monkeypatch.setattr(Q, "sketched", lambda df, columns, keys, k, f=Q.sketched: f(df, columns, keys, 8))
    pdf, df = numbers
    got = {r["g"]: r for r in Q.grouped_quantiles(df, ["u", "t", "s"], (0.25, 0.5, 0.75), ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for c in ("u", "t", "s"):
            assert list(got[g][c]) == pytest.approx(list(part[c].quantile([0.25, 0.5, 0.75])), rel=1e-12, abs=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert Q.fit_quantiles(df, ["a"], (0.5,)) == {}
    assert Q.fit_quantiles(df, [], (0.5,)) == {}


def test_running_counts(numbers):
    pdf, df = numbers
    counts = df.filter("u IS NOT NULL").groupBy("g", "u").count().withColumnRenamed("count", "n")
    got = {(r["g"], r["u"]): (r["before"], r["size"]) for r in Q.running_counts(counts, ["g"], "u", "n").collect()}
    for g, part in pdf.dropna().groupby("g"):
        v = np.sort(part["u"].to_numpy())
        for x in v[::97]:
            assert got[(g, x)] == (int((v < x).sum()), len(v))


def test_positions(spark):
    df = spark.range(1000, 3000, 2).repartition(4)
    rows = with_position(df, "id").collect()
    assert all(r["position"] == (r["id"] - 1000) // 2 for r in rows)


def test_blocks_reach_as_far_as_the_halo(spark):
    from plumbline.functions.positions import in_blocks
    rows = in_blocks(spark.range(100).withColumnRenamed("id", "position"), "position", 10, 25).collect()
    at = {}
    for r in rows:
        at.setdefault(r["__block"], set()).add(r["position"])
    for b in range(10):
        assert at[b] >= {p for p in range(100) if 10 * b - 25 <= p <= 10 * b + 9 + 25}


def test_grouped_quantiles_read_their_input_twice(spark):
    """Once for the sketches and once for the counts."""
    seen = spark.sparkContext.accumulator(0)

    def look(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    df = spark.range(3000).selectExpr("id % 3 AS g", "CAST(id * 7 % 1009 AS DOUBLE) AS x").mapInPandas(look, "g bigint, x double")
    got = {r["g"]: r["x"] for r in Q.grouped_quantiles(df, ["x"], (0.25, 0.75), ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile([i * 7 % 1009 for i in range(g, 3000, 3)], (0.25, 0.75)).tolist())
    assert seen.value == 2 * 3000


def test_counted_rows_weigh_as_many(spark):
    rows = [(g, float((i * 7919) % 1009), i % 3 + (500 if i == 40 else 1)) for g in ("a", None) for i in range(600)] + [("a", None, 9)]
    df = spark.createDataFrame(rows, "g string, x double, __count bigint").repartition(3)
    got = {(r["g"], r["q"]): r["value"] for r in Q.counted_quantiles(df, ["x"], (0.25, 0.5, 0.9), ["g"]).values.collect()}
    for g in ("a", None):
        whole = np.repeat(*zip(*[(x, n) for k, x, n in rows if k == g and x is not None]))
        assert [got[g, q] for q in range(3)] == pytest.approx(list(np.quantile(whole, (0.25, 0.5, 0.9))))
    every = np.repeat(*zip(*[(x, n) for _, x, n in rows if x is not None]))
    assert Q.fit_quantiles(df, ["x"], lambda n: [i / 7 for i in range(8)])["x"] == pytest.approx(list(np.quantile(every, [i / 7 for i in range(8)])))
