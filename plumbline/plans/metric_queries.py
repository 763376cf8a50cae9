"""Queries for the table and column metrics and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import numeric_features
from ..operators import metrics as M
from .registry import query, rounded
from .views import NOW, load, with_views

LI, OR, CU, EV = (with_views(n) for n in ("lineitem_q", "orders_q", "customer_q", "events_q"))
LI_COLS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
           "l_returnflag l_linestatus l_shipdate").split()
LI_NUM = LI_COLS[:8]


def one(name, view, **cfg):
    return lambda spark, sf: rounded(M.measure(name, load(spark, sf, view), **cfg))


def counts(cols):
    return " + ".join(f"count({c})" for c in cols)


COMPLETE = f"CAST({counts(LI_COLS)} AS DOUBLE) / (count(*) * {len(LI_COLS)})"
query("completeness", f"{LI} SELECT round({COMPLETE}, 6) AS value FROM lineitem_q")(one("completeness", "lineitem_q"))
query("column_completeness", f"{LI} SELECT round(CAST(count(l_discount) AS DOUBLE) / count(*), 6) AS value FROM lineitem_q")(
    one("column_completeness", "lineitem_q", column="l_discount"))


@query("completeness_by_group", f"{LI} SELECT l_returnflag, round(CAST({counts([c for c in LI_COLS if c != 'l_returnflag'])} AS DOUBLE)"
       f" / (count(*) * {len(LI_COLS) - 1}), 6) AS value FROM lineitem_q GROUP BY l_returnflag")
def _(spark, sf):
    return rounded(M.measure("completeness", load(spark, sf, "lineitem_q"), ["l_returnflag"]))


def iqr_sql(cols, by=""):
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in cols)
    bad = " + ".join(f"count(CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN 1 END)"
                     for c in cols)
    if not by:
        return f"s AS (SELECT {stats} FROM lineitem_q)", f"SELECT CAST({bad} AS DOUBLE) / (count(*) * {len(cols)}) AS outlier_rate FROM lineitem_q, s"
    return (f"s AS (SELECT {by} AS g, {stats} FROM lineitem_q GROUP BY {by})",
            f"SELECT {by}, round(CAST({bad} AS DOUBLE) / (count(*) * {len(cols)}), 6) AS value FROM lineitem_q JOIN s ON {by} = g GROUP BY {by}")


_cte, _sel = iqr_sql(LI_NUM)
query("outlier_rate_iqr", f"{LI}, {_cte} SELECT round(outlier_rate, 6) AS value FROM ({_sel})")(
    one("outlier_rate", "lineitem_q", method="iqr", threshold=1.5))
_cte_g, _sel_g = iqr_sql(LI_NUM, "l_returnflag")
query("outlier_rate_iqr_by_group", f"{LI}, {_cte_g} {_sel_g}")(
    lambda spark, sf: rounded(M.measure("outlier_rate", load(spark, sf, "lineitem_q"), ["l_returnflag"])))

_z = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in LI_NUM)
_zb = " + ".join(f"count(CASE WHEN d_{c} > 0 AND abs(({c} - m_{c}) / d_{c}) > 3.0 THEN 1 END)" for c in LI_NUM)
query("outlier_rate_zscore", f"{LI}, s AS (SELECT {_z} FROM lineitem_q) "
      f"SELECT round(CAST({_zb} AS DOUBLE) / (count(*) * {len(LI_NUM)}), 6) AS value FROM lineitem_q, s")(
    one("outlier_rate", "lineitem_q", method="zscore", threshold=3.0))
_m = ", ".join(f"median({c}) AS m_{c}" for c in LI_NUM)
_d = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in LI_NUM)
_mb = " + ".join(f"count(CASE WHEN d_{c} > 0 AND abs(0.6745 * ({c} - m_{c}) / d_{c}) > 3.5 THEN 1 END)" for c in LI_NUM)
query("outlier_rate_modz", f"{LI}, m AS (SELECT {_m} FROM lineitem_q), d AS (SELECT {_d} FROM lineitem_q, m) "
      f"SELECT round(CAST({_mb} AS DOUBLE) / (count(*) * {len(LI_NUM)}), 6) AS value FROM lineitem_q, m, d")(
    one("outlier_rate", "lineitem_q", method="modified_zscore", threshold=3.5))

_rate = "round(1 - CAST(count(*) AS DOUBLE) / sum(n), 6) AS value"
DOC_DUP = f"SELECT {_rate} FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)"
query("duplicate_rate", f"{LI} SELECT {_rate} FROM (SELECT {', '.join(LI_COLS)}, count(*) AS n FROM lineitem_q GROUP BY ALL)")(
    one("duplicate_rate", "lineitem_q"))
query("duplicate_rate_subset", f"{LI} SELECT {_rate} FROM (SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem_q GROUP BY ALL)")(
    one("duplicate_rate", "lineitem_q", subset=["l_orderkey", "l_linenumber", "l_quantity"]))
query("duplicate_rate_text", DOC_DUP)(one("duplicate_rate", "documents", subset=["text"]))
query("key_uniqueness", f"{LI} SELECT round(CAST(count(*) AS DOUBLE) / sum(n), 6) AS value FROM "
      "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem_q GROUP BY ALL)")(
    one("key_uniqueness", "lineitem_q", key_columns=["l_orderkey", "l_linenumber"]))

query("format_pattern", f"{CU} SELECT round(CAST(count(CASE WHEN regexp_matches(phone, '^(?:\\d{{3}}-\\d{{3}})') THEN 1 END) AS DOUBLE)"
      " / count(phone), 6) AS value FROM customer_q")(
    one("format_consistency", "customer_q", column="phone", pattern=r"\d{3}-\d{3}"))
query("format_length", f"{CU} SELECT round(1 / (1 + stddev_samp(length(email)) / avg(length(email))), 6) AS value FROM customer_q")(
    one("format_consistency", "customer_q", column="email"))


@query("referential_integrity", f"{OR} SELECT round(CAST(count(c_custkey) AS DOUBLE) / count(o_custkey), 6) AS value "
       "FROM orders_q LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON o_custkey = c_custkey")
def _(spark, sf):
    return rounded(M.measure("referential_integrity", load(spark, sf, "orders_q"), foreign_key="o_custkey",
                             reference=load(spark, sf, "customer"), reference_column="c_custkey"))


@query("label_coverage", "SELECT round(CAST(count(l.doc_id) AS DOUBLE) / count(d.doc_id), 6) AS value "
       "FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(spark, sf):
    return rounded(M.measure("referential_integrity", load(spark, sf, "documents"), foreign_key="doc_id",
                             reference=load(spark, sf, "labels"), reference_column="doc_id"))


RANGE = {"type": "range", "column": "age", "min": 18, "max": 60}
ENUM = {"type": "enum", "column": "c_mktsegment", "values": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}
CUSTOM = {"type": "custom", "column": "c_acctbal", "check": "c_acctbal >= 0"}
_bad = {"range": "count(CASE WHEN age < 18 OR age > 60 THEN 1 END)",
        "enum": "count(CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 1 END)",
        "custom": "count(CASE WHEN NOT (c_acctbal >= 0) THEN 1 END)"}
_n = {"range": "count(age)", "enum": "count(c_mktsegment)", "custom": "count(c_acctbal)"}
for _k, _c in (("range", RANGE), ("enum", ENUM), ("custom", CUSTOM)):
    query(f"constraint_{_k}", f"{CU} SELECT round(CAST({_bad[_k]} AS DOUBLE) / {_n[_k]}, 6) AS value FROM customer_q")(
        one("constraint_violation", "customer_q", constraints=[_c]))
query("constraint_all", f"{CU} SELECT round(CAST({' + '.join(_bad.values())} AS DOUBLE) / ({' + '.join(_n.values())}), 6) AS value FROM customer_q")(
    one("constraint_violation", "customer_q", constraints=[RANGE, ENUM, CUSTOM, {"type": "range", "column": "absent"}]))
query("type_validity", f"{OR} SELECT round(CAST(count(CASE WHEN regexp_full_match(o_ref, '[+-]?\\d+') THEN 1 END) + count(o_totalprice)"
      " + count(o_orderpriority) AS DOUBLE) / (count(o_ref) + count(o_totalprice) + count(o_orderpriority)), 6) AS value FROM orders_q")(
    one("type_validity", "orders_q", expected_types={"o_ref": "int", "o_totalprice": "float", "o_orderpriority": "str"}))


def skew_sql(c):
    """Population skewness from deviations around the mean m_<c>."""
    return f"abs(avg(power({c} - m_{c}, 3)) / power(avg(power({c} - m_{c}, 2)), 1.5))"


def kurt_sql(c):
    return f"abs(avg(power({c} - m_{c}, 4)) / power(avg(power({c} - m_{c}, 2)), 2) - 3)"


MEANS = "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in LI_NUM) + " FROM lineitem_q)"
SKEW = f"({' + '.join(skew_sql(c) for c in LI_NUM)}) / {len(LI_NUM)}"
KURT = f"({' + '.join(kurt_sql(c) for c in LI_NUM)}) / {len(LI_NUM)}"
query("skewness", f"{LI}, {MEANS} SELECT round({SKEW}, 6) AS value FROM lineitem_q, m")(one("distribution_skewness", "lineitem_q"))
query("kurtosis", f"{LI}, {MEANS} SELECT round({KURT}, 6) AS value FROM lineitem_q, m")(one("distribution_kurtosis", "lineitem_q"))
_age = f"avg(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 8.64e10 / 30"
query("freshness", f"{EV} SELECT round(exp(-{_age}), 6) AS value FROM events_q")(
    one("freshness", "events_q", timestamp_column="ts", current_time=NOW))
query("freshness_linear", f"{EV} SELECT round(greatest(0, 1 - {_age}), 6) AS value FROM events_q")(
    lambda spark, sf: rounded(load(spark, sf, "events_q").agg(
        M.freshness_linear(load(spark, sf, "events_q"), "ts", NOW).alias("value"))))


@query("accuracy_numeric", f"{OR} SELECT round(greatest(0, 1 - avg(abs((q.o_totalprice - o.o_totalprice) / nullif(o.o_totalprice, 0)))), 6) AS value "
       "FROM orders_q q JOIN orders o ON q.o_orderkey = o.o_orderkey")
def _(spark, sf):
    return rounded(M.measure("value_accuracy", load(spark, sf, "orders_q"), column="o_totalprice",
                             ground_truth=load(spark, sf, "orders"), on=["o_orderkey"]))


@query("accuracy_categorical", f"{OR} SELECT round(CAST(count(CASE WHEN q.o_orderpriority = o.o_orderpriority THEN 1 END) AS DOUBLE) / count(*), 6) AS value "
       "FROM orders_q q JOIN orders o ON q.o_orderkey = o.o_orderkey")
def _(spark, sf):
    return rounded(M.measure("value_accuracy", load(spark, sf, "orders_q"), column="o_orderpriority",
                             ground_truth=load(spark, sf, "orders"), on=["o_orderkey"]))


PARTS = (f"{LI}, {_cte}, o AS ({_sel}), {MEANS}, "
         f"d AS (SELECT 1 - CAST(count(*) AS DOUBLE) / sum(n) AS duplicate_rate FROM (SELECT {', '.join(LI_COLS)}, count(*) AS n FROM lineitem_q GROUP BY ALL)), "
         f"c AS (SELECT {COMPLETE} AS completeness, {SKEW} AS skew, {KURT} AS kurt FROM lineitem_q, m), "
         "r AS (SELECT c.*, outlier_rate, duplicate_rate FROM c, o, d) ")
query("overall_quality", f"{PARTS} SELECT round(.5 * completeness + .5 * (1 - outlier_rate), 6) AS value FROM r")(
    one("overall_quality", "lineitem_q"))
_w = {"completeness": 0.4, "outlier_rate": 0.4, "duplicate_rate": 0.2}
query("overall_quality_weighted", f"{PARTS} SELECT round(.4 * completeness + .4 * (1 - outlier_rate) + .2 * (1 - duplicate_rate), 6) AS value FROM r")(
    one("overall_quality", "lineitem_q", metric_weights=_w))

REPORT = {"completeness": "completeness", "outlier_rate": "outlier_rate", "duplicate_rate": "duplicate_rate",
          "distribution_skewness": "skew", "distribution_kurtosis": "kurt",
          "overall_quality": ".5 * completeness + .5 * (1 - outlier_rate)"}
REPORT_SQL = PARTS + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({e}, 6) AS value FROM r" for m, e in REPORT.items())


@query("quality_report", REPORT_SQL + f" UNION ALL SELECT 'key_uniqueness', round(CAST(count(*) AS DOUBLE) / sum(n), 6) FROM "
       "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem_q GROUP BY ALL)")
def quality_report(spark, sf):
    return rounded(M.default_catalog().compute_all(
        load(spark, sf, "lineitem_q"), {"key_uniqueness": {"key_columns": ["l_orderkey", "l_linenumber"]}}))


@query("quality_report_category", f"{PARTS} SELECT 'distribution_skewness' AS metric, round(skew, 6) AS value FROM r "
       "UNION ALL SELECT 'distribution_kurtosis', round(kurt, 6) FROM r")
def _(spark, sf):
    return rounded(M.default_catalog().compute_category("distribution", load(spark, sf, "lineitem_q")))


@query("custom_metric", f"{LI} SELECT 'discount_cap' AS metric, round(CAST(count(CASE WHEN l_discount <= 0.05 THEN 1 END) AS DOUBLE) / count(l_discount), 6) AS value FROM lineitem_q")
def _(spark, sf):
    cat = M.default_catalog()
    cat.register_aggregate("discount_cap", lambda df, limit=0.05: F.avg((F.col("l_discount") <= limit).cast("double")))
    return rounded(cat.compute_category("custom", load(spark, sf, "lineitem_q")))


@query("email_validity", f"{CU} SELECT round(CAST(count(CASE WHEN regexp_matches(email, '{M.EMAIL_PATTERN}') THEN 1 END) AS DOUBLE) / count(email), 6) AS value FROM customer_q")
def _(spark, sf):
    df = load(spark, sf, "customer_q")
    return rounded(df.agg(M.pattern_share(df, "email", M.EMAIL_PATTERN).alias("value")))


@query("phone_validity", f"{CU} SELECT round(CAST(count(CASE WHEN regexp_matches(phone, '{M.PHONE_PATTERN}') THEN 1 END) AS DOUBLE) / count(phone), 6) AS value FROM customer_q")
def _(spark, sf):
    df = load(spark, sf, "customer_q")
    return rounded(df.agg(M.pattern_share(df, "phone", M.PHONE_PATTERN).alias("value")))


@query("business_rule", f"{CU} SELECT round(CAST(count(CASE WHEN age >= 18 THEN 1 END) AS DOUBLE) / count(*), 6) AS value FROM customer_q WHERE status = 'active'")
def _(spark, sf):
    df = load(spark, sf, "customer_q")
    return rounded(df.agg(M.rule_share(df, "age >= 18", "status = 'active'").alias("value")))


@query("multi_column_consistency", f"{CU} SELECT round((CAST(count(CASE WHEN email IS NOT NULL AND phone IS NOT NULL AND (email <> 'invalid' OR phone = 'bad') THEN 1 END) "
       "+ count(CASE WHEN age >= 18 OR status = 'inactive' THEN 1 END) AS DOUBLE)) / (count(CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 1 END) + count(*)), 6) AS value FROM customer_q")
def _(spark, sf):
    df = load(spark, sf, "customer_q")
    rules = [(("email", "phone"), "email <> 'invalid' OR phone = 'bad'"), (("age", "status"), "age >= 18 OR status = 'inactive'")]
    return rounded(df.agg(M.multi_column_consistency(df, rules).alias("value")))


# -- scans -------------------------------------------------------------------------------------

@query("numeric_features", f"{LI} SELECT round(sum(l_quantity), 6) AS sum_quantity, round(sum(l_extendedprice), 4) AS sum_price, "
       "round(sum(l_discount), 6) AS sum_discount, round(sum(l_tax), 6) AS sum_tax, CAST(count(*) AS BIGINT) AS n, "
       "'l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' AS features FROM lineitem_q")
def _(spark, sf):
    df = numeric_features(load(spark, sf, "lineitem_q"), exclude=("key",))
    return df.agg(F.round(F.sum("l_quantity"), 6).alias("sum_quantity"), F.round(F.sum("l_extendedprice"), 4).alias("sum_price"),
                  F.round(F.sum("l_discount"), 6).alias("sum_discount"), F.round(F.sum("l_tax"), 6).alias("sum_tax"),
                  F.count(F.lit(1)).alias("n"), F.lit(",".join(df.columns)).alias("features"))
