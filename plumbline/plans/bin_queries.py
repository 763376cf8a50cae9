"""Queries for row metrics, bins, merging, scores and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import clean, count_rows, spread
from ..operators import bins as B
from ..operators import discretize as Z
from ..operators import rows as R
from ..operators import scoring as S
from ..operators import selection as L
from ..operators.binned import union_metrics
from .metric_queries import LI
from .registry import query, rounded
from .views import FEATURES, load

N_BINS = 20
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
SHORT = ("l_quantity", "l_discount", "l_extendedprice")
BIN_WEIGHTS = {"completeness": 0.3, "outlier_rate": 0.3, "duplicate_rate": 0.2, "overall_quality": 0.2}
LIMITS = {"completeness": (0.95, 1.0), "outlier_rate": (0.0, 0.02), "duplicate_rate": (0.0, 0.05)}


def lines(spark, sf):
    return load(spark, sf, "lineitem_q")


def measures(spark, sf):
    return spread(clean(lines(spark, sf).select(*FEATURES)))


# -- row metrics ---------------------------------------------------------------------------------

_n = len(FEATURES)
_fence = ", ".join(f"quantile_cont({c}, .25) AS a_{c}, quantile_cont({c}, .75) AS b_{c}" for c in FEATURES)
_inside = " + ".join(f"coalesce(CAST({c} BETWEEN a_{c} - 1.5 * (b_{c} - a_{c}) AND b_{c} + 1.5 * (b_{c} - a_{c}) AS INT), 0)" for c in FEATURES)
_filled = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in FEATURES)
_list = f"list_filter([{', '.join(f'CAST({c} AS DOUBLE)' for c in FEATURES)}], lambda x: x IS NOT NULL)"
ROW_SQL = (f"{LI}, f AS (SELECT {_fence} FROM lineitem_q), v AS (SELECT *, {_list} AS l FROM lineitem_q), "
           "u AS (SELECT *, list_avg(l) AS m, list_stddev_pop(l) AS d FROM v), "
           "t AS (SELECT median(d / abs(m)) AS t FROM u WHERE len(l) > 1 AND m <> 0), "
           f"r AS (SELECT u.*, CAST({_filled} AS DOUBLE) / {_n} AS row_completeness, "
           f"CASE WHEN ({_filled}) = 0 THEN 1.0 ELSE CAST({_inside} AS DOUBLE) / ({_filled}) END AS row_range_conformance, "
           "CASE WHEN len(l) < 2 OR abs(m) < 1e-10 THEN 1.0 ELSE least(1.0, exp(-abs(d / abs(m) - t) / t)) END AS row_consistency FROM u, f, t)")


def row_scores(metrics):
    def run(spark, sf):
        df = lines(spark, sf)
        model = R.fit_row_metrics(df, FEATURES, first_rows=None)
        return rounded(model.transform(df, metrics).select("l_orderkey", "l_linenumber", "l_partkey", *metrics))
    return run


for _m in R.ROW_METRICS:
    query(_m, f"{ROW_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round({_m}, 6) AS {_m} FROM r")(row_scores((_m,)))
query("row_metrics_all", f"{ROW_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, "
      + ", ".join(f"round({m}, 6) AS {m}" for m in R.ROW_METRICS) + " FROM r")(row_scores(R.ROW_METRICS))

# -- bins ------------------------------------------------------------------------------------------


def grid_sql(cols, n=N_BINS):
    probs = "[" + ", ".join(repr(i / n) for i in range(n + 1)) + "]"
    return "g AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS attr, list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) AS bs FROM lineitem_q" for c in cols) + ")"


def place(x):
    return f"greatest(0, least(len(list_filter(bs, lambda b: b <= {x})) - 1, len(bs) - 2))"


def binned_sql(cols, attrs=FEATURES):
    """e: every row once per attribute with its bin (NULL in no bin)."""
    body = " UNION ALL ".join(f"SELECT attr, {place(a)} AS bin_id, bs, {', '.join(cols)} FROM lineitem_q, g WHERE attr = '{a}' AND {a} IS NOT NULL"
                              for a in attrs)
    return f"{grid_sql(attrs)}, e AS ({body})"


def quality_sql(attrs=FEATURES, cols=FEATURES):
    """q: exact quality of every bin."""
    k = len(cols)
    st = ", ".join(f"quantile_cont({c}, .25) AS a_{c}, quantile_cont({c}, .75) AS b_{c}, avg({c}) AS m_{c}" for c in cols)
    out = " + ".join(f"CASE WHEN count({c}) >= 4 THEN count(CASE WHEN {c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) THEN 1 END) ELSE 0 END" for c in cols)
    full = " + ".join(f"count({c})" for c in cols)
    one = lambda c, f: f"CASE WHEN count({c}) >= 4 AND min({c}) < max({c}) THEN {f} END"
    sk = [one(c, f"abs(avg(power({c} - m_{c}, 3)) / power(avg(power({c} - m_{c}, 2)), 1.5))") for c in cols]
    ku = [one(c, f"abs(avg(power({c} - m_{c}, 4)) / power(avg(power({c} - m_{c}, 2)), 2) - 3)") for c in cols]
    return (f"{binned_sql(cols, attrs)}, st AS (SELECT attr AS sa, bin_id AS sb, {st} FROM e GROUP BY ALL), "
            f"dd AS (SELECT attr AS da, bin_id AS db, count(*) AS distinct_rows FROM (SELECT DISTINCT attr, bin_id, {', '.join(cols)} FROM e) GROUP BY ALL), "
            f"q0 AS (SELECT attr, bin_id, bs[bin_id + 1] AS lower, bs[bin_id + 2] AS upper, count(*) AS n, CAST({full} AS DOUBLE) / (count(*) * {k}) AS completeness, "
            f"CAST({out} AS DOUBLE) / (count(*) * {k}) AS outlier_rate, [{', '.join(sk)}] AS sk, [{', '.join(ku)}] AS ku "
            "FROM e JOIN st ON attr = sa AND bin_id = sb GROUP BY attr, bin_id, bs), "
            "q AS (SELECT q0.* EXCLUDE (sk, ku), (n - distinct_rows) / CAST(n AS DOUBLE) AS duplicate_rate, coalesce(list_avg(sk), 0) AS distribution_skewness, "
            "coalesce(list_avg(ku), 0) AS distribution_kurtosis, .5 * completeness + .5 * (1 - outlier_rate) AS overall_quality "
            "FROM q0 JOIN dd ON attr = da AND bin_id = db)")


QUALITY = quality_sql()
METRIC_LIST = ", ".join(f"round({m}, 6) AS {m}" for m in B.BIN_METRICS)
LONG = "v AS (" + " UNION ALL ".join(f"SELECT attr, bin_id, n, '{m}' AS metric, {m} AS value FROM q" for m in B.BIN_METRICS) + ")"


def flat(bins):
    return rounded(bins.select("attr", "bin_id", "lower", "upper", "n", *[F.col("quality")[m].alias(m) for m in B.BIN_METRICS]))


def all_bins(spark, sf, attrs=FEATURES):
    return B.fit_bins(lines(spark, sf), attrs, N_BINS, FEATURES)


@query("quantile_boundaries", f"{LI}, {grid_sql(FEATURES, 100)} SELECT attr, CAST(unnest(range(len(bs))) AS BIGINT) AS position, round(unnest(bs), 6) AS boundary FROM g")
def _(spark, sf):
    return rounded(B.boundaries_frame(spark, B.fit_boundaries(measures(spark, sf), FEATURES, 100)))


@query("bin_assign", f"{LI}, {binned_sql(['l_orderkey'], SHORT)} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum FROM e GROUP BY ALL")
def _(spark, sf):
    df = lines(spark, sf)
    binned = B.assign_bins(df, B.fit_boundaries(df, SHORT, N_BINS), null_bin=None)
    return rounded(B.by_bin(binned, SHORT, ["l_orderkey"]).groupBy("attr", "bin_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum")))


query("bin_quality", f"{LI}, {quality_sql(('l_extendedprice',))} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST} FROM q")(
    lambda spark, sf: flat(all_bins(spark, sf, ("l_extendedprice",))))
query("bin_quality_all", f"{LI}, {QUALITY} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST} FROM q")(
    lambda spark, sf: flat(all_bins(spark, sf)))
query("bin_summary", f"{LI}, {binned_sql(['l_orderkey'])}, c AS (SELECT attr, bin_id, count(*) AS n FROM e GROUP BY ALL) SELECT attr, count(*) AS n_bins, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM c GROUP BY attr")(
    lambda spark, sf: rounded(B.bin_summary(row_mean_bins(spark, sf))))


def row_mean_bins(spark, sf):
    """Bins with the mean row metrics as quality."""
    df = measures(spark, sf)
    model = R.fit_row_metrics(df, FEATURES, first_rows=None)
    return B.bin_means(model.transform(df), B.fit_boundaries(df, FEATURES, N_BINS), R.ROW_METRICS)


_cost = " + ".join(f"power({m} - n_{m}, 2) / {len(B.BIN_METRICS)}" for m in B.BIN_METRICS)
_lead = ", ".join(f"lead({m}) OVER w AS n_{m}" for m in B.BIN_METRICS)
query("merge_cost", f"{LI}, {QUALITY}, p AS (SELECT *, lead(bin_id) OVER w AS right_bin, lead(n) OVER w AS n2, {_lead} FROM q WINDOW w AS (PARTITION BY attr ORDER BY bin_id)) "
      f"SELECT attr, CAST(bin_id AS BIGINT) AS left_bin, CAST(right_bin AS BIGINT) AS right_bin, round(CAST(n AS DOUBLE) * n2 / (n + n2) * ({_cost}), 4) AS cost FROM p WHERE right_bin IS NOT NULL")(
    lambda spark, sf: rounded(Z.merge_cost(all_bins(spark, sf)), 4))

# Every second inner boundary removed: unions of neighbouring bins, measured on their rows.
@query("merged_bin_quality", f"{LI}, " + quality_sql(SHORT).replace(grid_sql(SHORT), grid_sql(SHORT).replace("g AS (", "g0 AS (", 1)
       + ", g AS (SELECT attr, bs[1:1] || list_filter(bs[2:-2], lambda b, i: i % 2 = 0) || bs[-1:] AS bs FROM g0)", 1)
       + f" SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST} FROM q")
def _(spark, sf):
    df = measures(spark, sf)
    fine = B.fit_boundaries(df, SHORT, N_BINS)
    merged = {a: [bs[0], *bs[1:-1][1::2], bs[-1]] for a, bs in fine.items()}
    return flat(B.bin_quality(df, merged, FEATURES))


query("separation", f"{LI}, {QUALITY}, {LONG}, x AS (SELECT attr, metric, coalesce(var_samp(value), 0) AS v FROM v GROUP BY ALL) SELECT attr, round(avg(v), 6) AS separation FROM x GROUP BY attr")(
    lambda spark, sf: rounded(Z.separation(all_bins(spark, sf))))


@query("homogeneity", f"{ROW_SQL}, {grid_sql(FEATURES)}, e AS (" + " UNION ALL ".join(
       f"SELECT attr, {place(a)} AS bin_id, row_completeness, row_range_conformance, row_consistency FROM r, g WHERE attr = '{a}' AND {a} IS NOT NULL" for a in FEATURES)
       + "), h AS (SELECT attr, bin_id, " + ", ".join(f"coalesce(var_samp({m}), 0) AS {m}" for m in R.ROW_METRICS) + " FROM e GROUP BY ALL) "
       "SELECT attr, round((avg(row_completeness) + avg(row_range_conformance) + avg(row_consistency)) / 3, 6) AS homogeneity FROM h GROUP BY attr")
def _(spark, sf):
    df = measures(spark, sf)
    model = R.fit_row_metrics(df, FEATURES, first_rows=None)
    return rounded(Z.homogeneity(model.transform(df), B.fit_boundaries(df, FEATURES, N_BINS)))


# -- configured metrics per bin and per union of bins -------------------------------------------------

CONFIGS = {"format_consistency": {"column": "l_returnflag", "pattern": "[AN]"},
           "constraint_violation": {"constraints": [{"column": "l_discount", "type": "range", "min": 0.02, "max": 0.08}]},
           "key_uniqueness": {"key_columns": ["l_orderkey"]}}
_configured = ("round(CAST(count(CASE WHEN regexp_matches(l_returnflag, '^(?:[AN])') THEN 1 END) AS DOUBLE) / count(l_returnflag), 6) AS format_consistency, "
               "round(coalesce(CAST(count(CASE WHEN l_discount < 0.02 OR l_discount > 0.08 THEN 1 END) AS DOUBLE) / nullif(count(l_discount), 0), 0), 6) AS constraint_violation, "
               "round(CAST(count(DISTINCT l_orderkey) AS DOUBLE) / count(*), 6) AS key_uniqueness")


def configured_rows(spark, sf):
    df = clean(lines(spark, sf).select(*FEATURES, "l_orderkey", "l_returnflag"))
    return df, B.fit_boundaries(df, FEATURES, N_BINS)


@query("bin_quality_configured", f"{LI}, {QUALITY}, y AS (SELECT attr, bin_id, {_configured} FROM (SELECT attr, bin_id, l_discount, l_returnflag, l_orderkey FROM "
       "(" + " UNION ALL ".join(f"SELECT attr, {place(a)} AS bin_id, l_discount, l_returnflag, l_orderkey FROM lineitem_q, g WHERE attr = '{a}' AND {a} IS NOT NULL" for a in FEATURES)
       + f")) GROUP BY ALL) SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST}, {', '.join(CONFIGS)} FROM q JOIN y USING (attr, bin_id)")
def _(spark, sf):
    df, bs = configured_rows(spark, sf)
    bins = B.bin_quality(df, bs, FEATURES, CONFIGS)
    return rounded(bins.select("attr", "bin_id", "lower", "upper", "n", *[F.col("quality")[m].alias(m) for m in (*B.BIN_METRICS, *CONFIGS)]))


@query("union_quality_configured", f"{LI}, {grid_sql(FEATURES)}, e AS ("
       + " UNION ALL ".join(f"SELECT attr, {place(a)} AS bin_id, len(bs) AS k, l_discount, l_returnflag, l_orderkey FROM lineitem_q, g WHERE attr = '{a}' AND {a} IS NOT NULL" for a in FEATURES)
       + "), u AS (SELECT attr, f.i AS first_bin, l.i AS last_bin FROM g, range(100) AS f(i), range(100) AS l(i) WHERE f.i <= l.i AND l.i < len(bs) - 1) "
       f"SELECT attr, first_bin, last_bin, {_configured} FROM e JOIN u USING (attr) WHERE bin_id BETWEEN first_bin AND last_bin GROUP BY attr, first_bin, last_bin")
def _(spark, sf):
    df, bs = configured_rows(spark, sf)
    values = union_metrics(spread(df), bs, CONFIGS)
    return rounded(values.groupBy("attr", F.col("first").alias("first_bin"), F.col("last").alias("last_bin")).pivot("metric", list(CONFIGS)).agg(F.first("value")))


# -- merging (no SQL: greedy and iterative) ----------------------------------------------------------

def histories(spark, sf, attrs=FEATURES, **options):
    return Z.collect_history(*history_of(count_rows(lines(spark, sf), FEATURES), attrs, **options))


def history_of(df, attrs=FEATURES, **options):
    bs = B.fit_boundaries(df, attrs, N_BINS)
    return Z.merge_history(df, bs, FEATURES, size_weight="share", **options), bs


@query("discretize")
def _(spark, sf):
    h = histories(spark, sf, ("l_extendedprice",))
    return flat(Z.bins_frame(spark, [Z.discretize(x, 0.0005) for x in h.values()]))


@query("discretize_all")
def _(spark, sf):
    return flat(Z.bins_frame(spark, [Z.discretize(x, 0.0005) for x in histories(spark, sf).values()]))


@query("merge_history")
def _(spark, sf):
    return rounded(history_of(count_rows(lines(spark, sf), FEATURES))[0].filter("metric = 'overall_quality'"))


@query("discretize_adaptive")
def _(spark, sf):
    return rounded(Z.discretization_frame(spark, [Z.discretize_adaptive(x) for x in histories(spark, sf).values()]))


@query("discretization_report")
def _(spark, sf):
    return rounded(Z.discretization_frame(spark, [Z.discretize(x) for x in histories(spark, sf).values()]))


@query("threshold_sweep")
def _(spark, sf):
    return rounded(Z.threshold_sweep(spark, list(histories(spark, sf).values()), (0.0001, 0.001, 0.01, 0.05, 0.1)))


# Below all costs nothing is merged, above all of them one bin is left; both can be measured on the rows.
@query("discretize_below_costs", f"{LI}, {QUALITY} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST} FROM q")
def _(spark, sf):
    return flat(Z.bins_frame(spark, [Z.discretize(x, -1.0) for x in histories(spark, sf).values()]))


@query("discretize_above_costs", f"{LI}, " + QUALITY.replace(grid_sql(FEATURES), grid_sql(FEATURES).replace("g AS (", "g0 AS (", 1)
       + ", g AS (SELECT attr, [bs[1], bs[-1]] AS bs FROM g0)", 1)
       + f" SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, round(lower, 6) AS lower, round(upper, 6) AS upper, n, {METRIC_LIST} FROM q")
def _(spark, sf):
    return flat(Z.bins_frame(spark, [Z.discretize(x, 1e18) for x in histories(spark, sf).values()]))


# -- scores ------------------------------------------------------------------------------------------

@query("entropy", f"{LI}, p AS (SELECT count(*) / CAST((SELECT count(*) FROM lineitem_q) AS DOUBLE) AS p FROM lineitem_q GROUP BY l_returnflag) SELECT round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM p")
def _(spark, sf):
    return rounded(S.entropy(lines(spark, sf), "l_returnflag"))


_dec = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
IG = (f"{LONG}, x AS (SELECT attr, metric, count(DISTINCT value) AS k, list_sort(list_distinct(quantile_cont(value, {_dec}))) AS es FROM v GROUP BY ALL), "
      "y AS (SELECT v.*, CASE WHEN k <= 10 THEN value ELSE len(list_filter(es[2:-2], lambda b: b < value)) END AS cat FROM v JOIN x USING (attr, metric)), "
      "z AS (SELECT attr, metric, cat, count(*) / CAST(sum(count(*)) OVER (PARTITION BY attr, metric) AS DOUBLE) AS p FROM y GROUP BY attr, metric, cat), "
      "ig AS (SELECT attr, metric, -sum(p * log2(p + 1e-10)) AS ig FROM z GROUP BY ALL)")
_w = "w AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {x} AS weight" for m, x in BIN_WEIGHTS.items()) + ")"
IGM = f"{IG}, {_w}, igm AS (SELECT attr, sum(ig * weight) AS ig_multi FROM ig JOIN w USING (metric) GROUP BY attr)"
_bad = " OR ".join(f"{m} < {a} OR {m} > {b}" for m, (a, b) in LIMITS.items())
QDP = (f"iss AS (SELECT attr, bin_id, n, ({_bad}) AS has_issue FROM q), qdp AS (SELECT attr, sum(CASE WHEN has_issue THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS qdp, "
       "count(*) AS n_bins, count(CASE WHEN has_issue THEN 1 END) AS n_issue_bins FROM iss GROUP BY attr)")
SCORES = f"{IGM}, {QDP}, sc AS (SELECT attr, ig_multi, qdp, .7 * ig_multi + .3 * qdp AS importance, n_bins, n_issue_bins FROM igm JOIN qdp USING (attr))"

query("information_gain", f"{LI}, {QUALITY}, {IG} SELECT attr, metric, round(ig, 6) AS ig FROM ig")(
    lambda spark, sf: rounded(S.information_gain(all_bins(spark, sf))))
query("ig_multi", f"{LI}, {QUALITY}, {IGM} SELECT attr, round(ig_multi, 6) AS ig_multi FROM igm")(
    lambda spark, sf: rounded(S.ig_multi(all_bins(spark, sf), BIN_WEIGHTS)))
query("issue_bins", f"{LI}, {QUALITY}, {QDP} SELECT attr, CAST(bin_id AS BIGINT) AS bin_id, n, has_issue FROM iss")(
    lambda spark, sf: rounded(S.issue_bins(all_bins(spark, sf), LIMITS)))
query("qdp", f"{LI}, {QUALITY}, {QDP} SELECT attr, round(qdp, 6) AS qdp, n_bins, n_issue_bins FROM qdp")(
    lambda spark, sf: rounded(S.qdp(all_bins(spark, sf), LIMITS)))
_sc = "attr, round(ig_multi, 6) AS ig_multi, round(qdp, 6) AS qdp, round(importance, 6) AS importance, n_bins, n_issue_bins"
query("feature_scores", f"{LI}, {QUALITY}, {SCORES} SELECT {_sc} FROM sc")(
    lambda spark, sf: rounded(S.feature_scores(all_bins(spark, sf), BIN_WEIGHTS, LIMITS)))
query("top_features", f"{LI}, {QUALITY}, {SCORES} SELECT {_sc} FROM sc ORDER BY sc.importance DESC, attr LIMIT 3")(
    lambda spark, sf: rounded(S.top_features(S.feature_scores(all_bins(spark, sf), BIN_WEIGHTS, LIMITS), 3)))
MIXES = ((1.0, 0.0), (0.7, 0.3), (0.5, 0.5), (0.3, 0.7), (0.0, 1.0))
_mix = "mx AS (" + " UNION ALL ".join(f"SELECT {a} AS alpha, {b} AS beta" for a, b in MIXES) + ")"
query("weight_sensitivity", f"{LI}, {QUALITY}, {SCORES}, {_mix}, rk AS (SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, attr, alpha * ig_multi + beta * qdp AS importance, "
      "row_number() OVER (PARTITION BY alpha, beta ORDER BY alpha * ig_multi + beta * qdp DESC, attr) AS rank FROM sc, mx) SELECT alpha, beta, rank, attr, round(importance, 6) AS importance FROM rk WHERE rank <= 3")(
    lambda spark, sf: rounded(S.weight_sensitivity(all_bins(spark, sf), MIXES, 3, BIN_WEIGHTS, LIMITS)))
query("final_boundaries", f"{LI}, {QUALITY}, o AS (SELECT attr, list_sort(list(lower)) || [max(upper)] AS b FROM q GROUP BY attr) SELECT attr, CAST(unnest(range(len(b))) AS BIGINT) AS position, round(unnest(b), 6) AS boundary FROM o")(
    lambda spark, sf: rounded(B.final_boundaries(row_mean_bins(spark, sf)).select("attr", F.posexplode("boundaries").alias("position", "boundary"))))


# -- selection -----------------------------------------------------------------------------------------

def ranked_features(spark, found):
    scores = S.feature_scores(Z.bins_frame(spark, found), BIN_WEIGHTS, LIMITS)
    return [(r["attr"], r["importance"]) for r in scores.select("attr", "importance").collect()]


def chosen(spark, sf, budget, **limits):
    h = histories(spark, sf)
    found = {a: Z.discretize_adaptive(x) for a, x in h.items()}
    return L.select_features(ranked_features(spark, list(found.values())), found, h, budget, **limits)


@query("select_features")
def _(spark, sf):
    return rounded(chosen(spark, sf, 30).frame(spark))


@query("select_constrained")
def _(spark, sf):
    return rounded(chosen(spark, sf, 30, max_homogeneity=0.02, min_separation=0.005).frame(spark))


@query("selection_summary")
def _(spark, sf):
    return rounded(chosen(spark, sf, 30).summary(spark))


@query("select_given_scores", f"{LI.replace('WITH', 'WITH RECURSIVE', 1)}, {grid_sql(FEATURES)}, c AS (SELECT attr, len(bs) - 1 AS n_bins, row_number() OVER (ORDER BY attr) AS rank FROM g), "
       "w AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, '' AS attr, CAST(0 AS BIGINT) AS n_bins, false AS selected "
       "UNION ALL SELECT c.rank, used + CASE WHEN c.n_bins <= 30 - used THEN c.n_bins ELSE 0 END, c.attr, c.n_bins, c.n_bins <= 30 - used FROM w JOIN c ON c.rank = w.rank + 1) "
       "SELECT attr, rank, n_bins, selected FROM w WHERE rank > 0")
def _(spark, sf):
    """The walk under a budget on a given ranking, by name, and given bins: those of the boundaries."""
    bs = B.fit_boundaries(measures(spark, sf), FEATURES, N_BINS)
    bins = {a: [Z.Bin(i, i, lo, hi, 1, {}) for i, (lo, hi) in enumerate(zip(b, b[1:]))] for a, b in bs.items()}
    found = {a: Z.assess(a, x, 0.0, "bin") for a, x in bins.items()}
    picked = L.select_features([(a, 1.0) for a in sorted(bs)], found, {a: Z.MergeHistory(a, x, []) for a, x in bins.items()}, 30, adjust=False)
    return rounded(picked.frame(spark).drop("importance", "adjusted"))
