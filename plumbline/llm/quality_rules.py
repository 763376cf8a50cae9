"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio (all native).

Words of all documents and of the trusted ones are hashed, alone and in pairs, into a fixed number of buckets.
Both counts make smoothed multinomials; a document's verdict is the mean over its n-grams of log p(trusted)/p(corpus)
against a fixed threshold. The counts cover every document; only `buckets` numbers reach the driver.

Defined cases: null or empty text has no words, fails the base rules and scores 0; repeated rows and tied scores are
each judged alone (score >= threshold is kept); without trusted rows every ratio is 0, so only the base rules decide;
an empty table gives an empty result; other columns are ignored by `judge` and returned untouched by `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, texts, words_of

BUCKETS = 1 << 14
THRESHOLD = -0.04
PRIOR = 1000.0          # n-grams, spread like the corpus, that every bucket counts besides its own
SYMBOLS = "[#*$%&|<>]"


def base_counts(rows: DataFrame) -> DataFrame:
    """doc_id, text, ws (words) and the five counts of every text."""
    rows = rows.withColumn("ws", words_of(WORD))
    rows = rows.withColumn("n_words", F.size("ws").cast("long"))
    rows = rows.withColumn("w3", F.expr(
        "if(n_words < 3, cast(array() as array<bigint>), "
        "transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])))"))
    # Sorted (hash, place) pairs: a window is a repeat if a neighbour has the same hash. The second condition never
    # holds; it keeps the pairs a column of their own (see common.words_of).
    rows = rows.withColumn("pairs", F.expr(
        "if(size(array_distinct(w3)) = size(w3) or spark_partition_id() < 0, null, array_sort(transform(w3, (h, i) -> struct(h, i))))"))
    covered = ("size(array_distinct(flatten(transform(filter(pairs, (p, k) -> p.h = get(pairs, k - 1).h or "
               "p.h = get(pairs, k + 1).h), p -> array(p.i, p.i + 1, p.i + 2)))))")
    lines = f"filter(split(text, '\\n'), l -> l rlike r'{WORD}')"
    return rows.withColumns({
        "word_chars": F.expr("cast(length(array_join(ws, '')) as bigint)"),
        "n_symbols": F.expr(f"cast(regexp_count(text, r'{SYMBOLS}') as bigint)"),
        "lines": F.expr(lines),
        "n_repeat_words": F.expr(f"cast(if(pairs is null, 0, {covered}) as bigint)"),
    }).withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)")).drop("lines", "w3", "pairs")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _grams(buckets: int) -> str:
    """SQL array of the bucket of every word and of every pair of neighbours of `ws`."""
    return (f"concat(transform(ws, w -> cast(pmod(xxhash64(w), {buckets}) as int)), "
            f"if(size(ws) < 2, cast(array() as array<int>), "
            f"transform(sequence(0, size(ws) - 2), i -> cast(pmod(xxhash64(ws[i], ws[i + 1]), {buckets}) as int))))")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log p(trusted)/p(corpus) per bucket. `trusted` holds the doc_id of the trusted documents.

    All documents are counted, partial sums per task before the shuffle. The prior draws the ratio of a bucket with few
    n-grams towards that of the whole corpus, so that a small corpus rejects only what it has much evidence against.
    """
    ids = trusted.select(F.col("doc_id").alias("t_id")).dropDuplicates()
    rows = texts(docs).join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("t_id"), "left")
    counts = (rows.select(F.col("t_id").isNotNull().cast("long").alias("good"),
                          words_of(WORD).alias("ws"))
              .select("good", F.explode(F.expr(_grams(buckets))).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g")).collect())
    n, g = [0] * buckets, [0] * buckets
    for r in counts:
        n[r["b"]], g[r["b"]] = r["n"], r["g"]
    if not sum(g):
        return [0.0] * buckets
    share = sum(g) / sum(n)
    return [math.log((b + prior * share) / (a + prior)) - math.log(share) for a, b in zip(n, g)]


def _with_score(rows: DataFrame, ratios: list[float]) -> DataFrame:
    buckets = len(ratios)
    table = "cast(split('" + ",".join(f"{x:.6g}" for x in ratios) + "', ',') as array<double>)"
    add = f"a + {table}[cast(pmod(xxhash64(ws[i]), {buckets}) as int)]"
    pair = f" + if(i + 1 < size(ws), {table}[cast(pmod(xxhash64(ws[i], ws[i + 1]), {buckets}) as int)], 0D)"
    total = f"aggregate(sequence(0, size(ws) - 1), 0D, (a, i) -> {add}{pair})"
    return rows.withColumn("score", F.expr(f"if(size(ws) = 0, 0D, {total} / (2 * size(ws) - 1))"))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    rows = _with_score(base_counts(texts(docs)), log_ratios(docs, trusted, buckets))
    rows = rows.withColumn("base_failed", base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def keep(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that pass, with their columns as they were."""
    ratios = log_ratios(docs, trusted, buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _with_score(base_counts(rows), ratios)
    return rows.filter(~base_failed() & (F.col("score") >= threshold)).select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that the labels mark as good throughout."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
