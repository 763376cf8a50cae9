"""Queries for flags, profiles, correlation, drift and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import shared_dir
from ..operators import correlation as C
from ..operators import drift as D
from ..operators import profile as P
from ..sources import storage as T
from ..sources import tables as S
from .metric_queries import CU, EV, LI, LI_COLS, LI_NUM, OR
from .registry import query, rounded
from .views import DRIFT_FROM, FEATURES, load

PRICE = "l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 6) AS l_extendedprice"


def flagged(method):
    def run(spark, sf):
        df = load(spark, sf, "lineitem_q").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        return rounded(P.flag_outliers(df, "l_extendedprice", method))
    return run


query("flag_outliers_iqr", f"{LI}, s AS (SELECT quantile_cont(l_extendedprice, .25) AS a, quantile_cont(l_extendedprice, .75) AS b FROM lineitem_q) "
      f"SELECT {PRICE}, coalesce(l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a), false) AS is_outlier FROM lineitem_q, s")(
    flagged("iqr"))
query("flag_outliers_zscore", f"{LI}, s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem_q) "
      f"SELECT {PRICE}, coalesce(abs(l_extendedprice - m) / d > 3, false) AS is_outlier FROM lineitem_q, s")(flagged("zscore"))
query("flag_outliers_modz", f"{LI}, m AS (SELECT median(l_extendedprice) AS m FROM lineitem_q), d AS (SELECT median(abs(l_extendedprice - m)) AS d FROM lineitem_q, m) "
      f"SELECT {PRICE}, coalesce(abs(0.6745 * (l_extendedprice - m) / d) > 3.5, false) AS is_outlier FROM lineitem_q, m, d")(flagged("modified_zscore"))


@query("flag_range", f"{CU} SELECT c_custkey, CAST(age AS BIGINT) AS age, coalesce(age BETWEEN 18 AND 60, false) AS valid FROM customer_q")
def _(spark, sf):
    return rounded(load(spark, sf, "customer_q").select("c_custkey", "age", P.in_range("age", 18, 60).alias("valid")))


@query("flag_enum", f"{OR} SELECT o_orderkey, o_orderpriority, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS valid FROM orders_q")
def _(spark, sf):
    return load(spark, sf, "orders_q").select("o_orderkey", "o_orderpriority", P.in_enum("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("valid"))


_mask = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in LI_COLS)


@query("missing_pattern", f"{LI} SELECT {_mask} AS pattern, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM lineitem_q), 6) AS percentage FROM lineitem_q GROUP BY 1")
def _(spark, sf):
    got = P.missing_pattern(load(spark, sf, "lineitem_q"))
    return rounded(got.withColumn("pattern", F.expr("array_join(transform(pattern, m -> IF(m, '1', '0')), '')")))


def pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


RANK_COLS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
_pearson = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem_q"
                              for a, b in pairs(["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
query("corr_pearson", f"{LI} {_pearson}")(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "pearson", FEATURES)))
_ranks = ("(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, "
          "rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem_q WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
_spearman = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(x, y), 6) AS correlation FROM {_ranks.format(a=a, b=b)}"
                               for a, b in pairs(["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
query("corr_spearman", f"{LI} {_spearman}")(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "spearman", FEATURES)))
_tau = ("(WITH p AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem_q WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), "
        "s AS (SELECT sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s FROM p, p q), "
        "t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM p), "
        "tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY x)), "
        "ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY y)) "
        "SELECT '{a}' AS column_a, '{b}' AS column_b, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS correlation FROM s, t, tx, ty)")
query("corr_kendall", f"{LI} " + " UNION ALL ".join(f"SELECT * FROM {_tau.format(a=a, b=b)}" for a, b in pairs(RANK_COLS)))(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "kendall", RANK_COLS)))


# The same over every numeric column. Kendall has no SQL: it would be quadratic in the distinct values.
_pearson_all = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem_q" for a, b in pairs(LI_NUM))
query("corr_pearson_all", f"{LI} {_pearson_all}")(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "pearson")))
_spearman_all = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(x, y), 6) AS correlation FROM {_ranks.format(a=a, b=b)}" for a, b in pairs(LI_NUM))
query("corr_spearman_all", f"{LI} {_spearman_all}")(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "spearman")))
query("corr_kendall_all")(
    lambda spark, sf: rounded(C.correlation(load(spark, sf, "lineitem_q"), "kendall")))


def _top_share(c):
    return f"SELECT '{c}' AS column, max(n) / sum(n) AS top_share FROM (SELECT {c}, CAST(count(*) AS DOUBLE) AS n FROM lineitem_q WHERE {c} IS NOT NULL GROUP BY 1)"


query("constant_columns", f"{LI} SELECT \"column\", round(top_share, 6) AS top_share FROM ({' UNION ALL '.join(map(_top_share, LI_COLS))}) WHERE top_share >= 0.3")(
    lambda spark, sf: rounded(P.constant_columns(load(spark, sf, "lineitem_q"), 0.3)))
_card = " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}) AS distinct_share FROM orders_q"
                           for c in "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority o_ref".split())
query("high_cardinality", f"{OR} SELECT \"column\", round(distinct_share, 6) AS distinct_share FROM ({_card}) WHERE distinct_share >= 0.9")(
    lambda spark, sf: rounded(P.high_cardinality_columns(load(spark, sf, "orders_q"), 0.9)))
query("value_frequency", f"{LI} SELECT l_quantity AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM lineitem_q), 6) AS percentage "
      "FROM lineitem_q WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda spark, sf: rounded(P.value_frequency(load(spark, sf, "lineitem_q"), "l_quantity", 10)))


def normalized(method):
    return lambda spark, sf: rounded(P.normalize(
        load(spark, sf, "lineitem_q").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice", method))


for _method, _stats, _expr in (
        ("minmax", "min(l_extendedprice) AS a, max(l_extendedprice) AS b", "(l_extendedprice - a) / (b - a)"),
        ("zscore", "avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS b", "(l_extendedprice - a) / b"),
        ("robust", "median(l_extendedprice) AS a, quantile_cont(l_extendedprice, .75) - quantile_cont(l_extendedprice, .25) AS b", "(l_extendedprice - a) / b")):
    query(f"normalize_{_method}", f"{LI}, s AS (SELECT {_stats} FROM lineitem_q) SELECT {PRICE}, round({_expr}, 6) AS normalized FROM lineitem_q, s")(
        normalized(_method))

TYPES = dict(zip(LI_COLS, "bigint bigint bigint int double double double double string string timestamp_ntz".split()))
_prof = " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) AS total_count, count(*) - count({c}) AS missing_count, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percentage, count(DISTINCT {c}) AS unique_count, "
    f"round(100.0 * count(DISTINCT {c}) / count(*), 6) AS unique_percentage FROM lineitem_q" for c, t in TYPES.items())
query("profile_columns", f"{LI} {_prof}")(
    lambda spark, sf: rounded(P.profile_columns(load(spark, sf, "lineitem_q")).drop("most_common", "most_common_count", "most_common_percentage")))
_pnum = " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, "
    f"round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem_q"
    for c in FEATURES)
query("profile_numeric", f"{LI} {_pnum}")(
    lambda spark, sf: rounded(P.profile_numeric(load(spark, sf, "lineitem_q"), FEATURES)))
_pnum_all = " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, "
    f"round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem_q"
    for c in LI_NUM)
query("profile_numeric_all", f"{LI} {_pnum_all}")(
    lambda spark, sf: rounded(P.profile_numeric(load(spark, sf, "lineitem_q"))))
_pcat = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column, {c} AS most_common, count(*) AS most_common_count, "
    f"round(100.0 * count(*) / (SELECT count(*) FROM lineitem_q), 6) AS most_common_percentage FROM lineitem_q WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 3 DESC, 2 LIMIT 1)"
    for c in ("l_returnflag", "l_linestatus"))
query("profile_categorical", f"{LI} {_pcat}")(
    lambda spark, sf: rounded(P.profile_columns(load(spark, sf, "lineitem_q"), ["l_returnflag", "l_linestatus"]).select(
        "column", "most_common", "most_common_count", "most_common_percentage")))


def split_events(spark, sf):
    ev = load(spark, sf, "events_q")
    at = F.lit(DRIFT_FROM).cast("timestamp_ntz")
    return ev.filter(F.col("ts") < at), ev.filter(F.col("ts") >= at)


def _ks(c):
    return (f"SELECT '{c}' AS column, n, m, max(abs(fr - fc)) AS d FROM (SELECT {c}, sum(sum(r)) OVER (ORDER BY {c}) / max(n) OVER () AS fr, "
            f"sum(sum(k)) OVER (ORDER BY {c}) / max(m) OVER () AS fc, n, m FROM (SELECT {c}, CASE WHEN ts < TIMESTAMP '{DRIFT_FROM}' THEN 1.0::DOUBLE ELSE 0 END AS r, "
            f"CASE WHEN ts < TIMESTAMP '{DRIFT_FROM}' THEN 0 ELSE 1.0::DOUBLE END AS k, "
            f"CAST(count({c}) FILTER (WHERE ts < TIMESTAMP '{DRIFT_FROM}') OVER () AS DOUBLE) AS n, CAST(count({c}) FILTER (WHERE ts >= TIMESTAMP '{DRIFT_FROM}') OVER () AS DOUBLE) AS m "
            f"FROM events_q WHERE {c} IS NOT NULL) GROUP BY {c}, n, m) GROUP BY n, m")


@query("drift_ks", f"{EV}, d AS ({_ks('value')} UNION ALL {_ks('user_id')}), z AS (SELECT *, d * sqrt(n * m / (n + m)) AS z FROM d), "
       "p AS (SELECT *, CASE WHEN z < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z))))) END AS p FROM z) "
       "SELECT \"column\", round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS has_drift FROM p")
def _(spark, sf):
    ref, cur = split_events(spark, sf)
    return rounded(D.drift_ks(ref, cur, columns=["value", "user_id"]))


@query("drift_chi2", f"{EV}, k AS (SELECT event_type, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS c "
       "FROM events_q WHERE event_type IS NOT NULL GROUP BY 1), s AS (SELECT sum(r) AS sr, sum(c) AS sc FROM k) "
       "SELECT 'event_type' AS \"column\", round(sum(power(c - r * sc / sr, 2) / (r * sc / sr)), 6) AS statistic, count(*) - 1 AS dof FROM k, s")
def _(spark, sf):
    ref, cur = split_events(spark, sf)
    return rounded(D.drift_chi2(ref, cur, columns=["event_type"]).select("column", "statistic", "dof"))


def _chi2(c):
    return (f"SELECT '{c}' AS \"column\", round(sum(power(c - r * sc / sr, 2) / (r * sc / sr)), 6) AS statistic, count(*) - 1 AS dof FROM "
            f"(SELECT {c}, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS c "
            f"FROM events_q WHERE {c} IS NOT NULL GROUP BY 1), (SELECT CAST(count({c}) FILTER (WHERE ts < TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS sr, "
            f"CAST(count({c}) FILTER (WHERE ts >= TIMESTAMP '{DRIFT_FROM}') AS DOUBLE) AS sc FROM events_q)")


@query("drift_chi2_all", f"{EV} {_chi2('event_type')} UNION ALL {_chi2('props')}")
def _(spark, sf):
    ref, cur = split_events(spark, sf)
    return rounded(D.drift_chi2(ref, cur, columns=["event_type", "props"]).select("column", "statistic", "dof"))


@query("drift_chi2_test")
def _(spark, sf):
    ref, cur = split_events(spark, sf)
    return rounded(D.drift_chi2(ref, cur, columns=["event_type", "user_id"]))


_mcorr = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) AS correlation FROM orders_q"
                            for a, b in pairs(["o_custkey", "o_totalprice", "o_orderpriority"]))
query("missing_corr", f"{OR} SELECT column_a, column_b, round(correlation, 6) AS correlation FROM ({_mcorr}) WHERE abs(correlation) >= 0.0")(
    lambda spark, sf: rounded(P.correlated_missing(load(spark, sf, "orders_q"), 0.0)))


@query("validate_schema", f"{OR} SELECT * FROM (SELECT 'missing_columns' AS category, 'o_comment' AS column, 'column is missing' AS message "
       "UNION ALL SELECT 'type_errors', 'o_ref', 'expected int, got string' "
       "UNION ALL SELECT DISTINCT 'range_errors', 'o_totalprice', 'values below minimum 1000' FROM orders_q WHERE o_totalprice < 1000 "
       "UNION ALL SELECT DISTINCT 'range_errors', 'o_totalprice', 'values above maximum 1000000' FROM orders_q WHERE o_totalprice > 1000000 "
       "UNION ALL SELECT DISTINCT 'missing_required', 'o_custkey', 'required column has nulls' FROM orders_q WHERE o_custkey IS NULL)")
def _(spark, sf):
    return P.validate_schema(load(spark, sf, "orders_q"), {
        "o_orderkey": {"type": "int", "required": True}, "o_custkey": {"type": "int", "required": True},
        "o_totalprice": {"type": "float", "min": 1000, "max": 1000000}, "o_ref": {"type": "int"}, "o_comment": {"type": "str"}})


# -- row selection ------------------------------------------------------------------------------

@query("drop_null_rows", f"{LI} SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount "
       "FROM lineitem_q WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def _(spark, sf):
    df = load(spark, sf, "lineitem_q").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return rounded(S.drop_null_rows(df))


@query("limit_rows", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, sf):
    return rounded(S.first_rows(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 1000))


@query("sample_rows", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY md5(o_orderkey || '-42'), o_orderkey LIMIT 2000")
def _(spark, sf):
    return rounded(S.sample_rows(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 2000, seed=42))


@query("csv_scan", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    """The orders written as CSV and read back with a declared schema."""
    df, path = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), shared_dir(spark, "csv")
    df.write.option("header", True).csv(path)
    return rounded(S.read_csv(spark, path, df.schema))


@query("result_sink", "SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 6) AS largest FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    """A result written as JSON lines and read back."""
    found = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest"))
    path = shared_dir(spark, "results")
    T.save_results(found, path)
    return rounded(T.load_results(spark, path, found.schema))
