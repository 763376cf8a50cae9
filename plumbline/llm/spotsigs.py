"""Document fingerprints by SpotSigs (all native).

A signature is a chain of CHAIN content words that follows a common word (an anchor) of several languages; the set of
hashed signatures is the fingerprint. Chains sit where prose is, so headings and link lists add few. Likeness is the
Jaccard of two sets, pruned by their lengths: it can't exceed the shorter length over the longer one. `near_pairs` joins
whole collections: sets are partitioned by length, each is looked for only in its own and the next partition, over the
rarest signatures, of which two sets that alike must share one.

Defined cases: null text is empty; a text without words has the empty set, and two empty sets are equal (likeness 1); a
text without any anchored chain has the hash of all its words as its one signature; equal texts have equal fingerprints;
rows are ordered by id (null first), then text; the next document of the last is the first, a lone document is its own;
repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

# Common words of English, German, French and Spanish.
ANCHORS = ("the of and to in is was that for with are this from by be on as at it he "
           "der die das und den von zu ist mit des auf für im dem nicht ein eine als auch "
           "le la les de et un une est dans que qui pour par sur au du en "
           "el los las y del por con para su se lo al no").split()
CHAIN = 2
LIKE = 0.8


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted distinct 32-bit hashes of the anchored chains of a text column."""
    anchors = "|".join(dict.fromkeys(ANCHORS))
    # The condition always holds; it keeps the words a column of their own (see common.words_of).
    kept = F.when(F.spark_partition_id() >= 0, F.lower(text))
    plain = F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))
    # Every anchor is glued to the word after it, so what is left between spaces are content words with their anchors.
    rows = rows.withColumn("_ws", F.split(F.regexp_replace(plain, rf"(?<![^ ])({anchors}) ", "$1_"), " "))
    tail = "".join(f", substring_index(_ws[i + {k}], '_', -1)" for k in range(1, CHAIN))
    found = (f"if(size(_ws) < {CHAIN}, cast(array() as array<int>), sort_array(array_distinct(transform(filter("
             f"sequence(0, size(_ws) - {CHAIN}), i -> contains(_ws[i], '_')), i -> hash(_ws[i]{tail})))))")
    rows = rows.withColumn("_found", F.expr(found))
    whole = "if(_ws[0] = '', cast(array() as array<int>), array(hash(array_join(_ws, ' '))))"
    return rows.withColumn(out, F.expr(f"if(size(_found) > 0, _found, {whole})")).drop("_ws", "_found")


def likeness(a: str, b: str, floor: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without a comparison where their lengths rule out `floor`."""
    both = F.size(F.array_intersect(a, b))
    exact = F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))
    return F.when(F.least(F.size(a), F.size(b)) < floor * F.greatest(F.size(a), F.size(b)), 0.0).otherwise(exact)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows by (doc_id, text), the first row after the last.

    Ids are cut into about sqrt(n) ranges. A range also gets a copy of the first row of the range after it, so every
    neighbour is found inside one range, and the texts are shuffled once. The cuts and the first ids, one per range,
    are what the driver holds and broadcasts.
    """
    spark, n = rows.sparkSession, rows.count()
    ids = rows.select("doc_id")
    k = max(1, math.isqrt(n))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 10 * k).alias("c")).first()["c"] or []
    inner = sorted({float(c) for c in cuts})
    edges = [-math.inf, *inner, math.inf] if inner else [-math.inf, 0.0, math.inf]
    cut = Bucketizer(splits=edges, inputCol="_id", outputCol="_at", handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        at = cut.transform(df.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))).drop("_id")
        return at.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_at").cast("int"))).drop("_at")

    firsts = sorted((r["_range"], r["first"]) for r in ranged(ids).groupBy("_range").agg(F.min("doc_id").alias("first")).collect())
    guests = [(first, firsts[i - 1][0], int(i == 0)) for i, (_, first) in enumerate(firsts)]
    guest = spark.createDataFrame(guests, "_first bigint, _to int, _wrap int")
    sent = ranged(rows).join(F.broadcast(guest), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("wrap"), F.lit(True).alias("own"))
    other = F.struct(F.col("_to").alias("r"), F.col("_wrap").alias("wrap"), F.lit(False).alias("own"))
    sent = sent.withColumn("_p", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, other))))
    over = "over (partition by _p.r order by _p.wrap, _p.own desc, doc_id nulls first, text)"
    nexts = {f"next_{c}": F.expr(f"lead({c}) {over}") for c in columns}
    return sent.withColumns(nexts).filter("_p.own").drop("_first", "_to", "_wrap", "_range", "_p")


def edited_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text, sig, n_chars, edited, edited_sig, next_sig: every text, and the text with its last half replaced by
    the beginning of the next document."""
    rows = with_next(with_signatures(texts(docs), "text", "sig"), ["text", "sig"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr(
        "concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    return with_signatures(rows.drop("next_text"), "edited", "edited_sig")


def as_text(sig: str) -> Column:
    return F.array_join(F.col(sig).cast("array<string>"), " ")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return edited_copies(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"))


def near_pairs(docs: DataFrame, like: float = LIKE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of distinct fingerprints at least that alike, and the membership (doc_id, class).

    A class is the hash of a fingerprint. Two sets with Jaccard >= like share one of the |s| - ceil(like |s|) + 1
    rarest signatures of each, and their lengths lie in the same or neighbouring partitions of ratio 1 / like.
    """
    rows = with_signatures(texts(docs), "text", "sig")
    member = written(rows.select("doc_id", F.sha2(as_text("sig").cast("binary"), 256).alias("class"), "sig"), "spotsigs")
    sets = written(member.groupBy("class").agg(F.first("sig").alias("sig")).filter("size(sig) > 0").withColumn(
        "part", F.floor(F.log(F.size("sig")) / math.log(1 / like) + 1e-9)), "sets")
    flat = sets.select("class", "part", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    seen = flat.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rank = flat.join(seen, "s").withColumn("k", F.expr("row_number() over (partition by class order by df, s)"))
    rare = rank.filter(F.col("k") <= F.col("n") - F.ceil(like * F.col("n") - 1e-9) + 1).select("class", "part", "n", "s")
    left = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "s", "part")
    met = left.join(right, ["s", "part"]).filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= like * F.col("nb") - 1e-9))
    met = met.select("a", "b").distinct()
    for side in "ab":
        met = met.join(sets.select(F.col("class").alias(side), F.col("sig").alias(f"s{side}")), side)
    pairs = met.select("a", "b", likeness("sa", "sb", like - 1e-9).alias("likeness")).filter(F.col("likeness") >= like - 1e-9)
    return pairs, member.select("doc_id", "class")
