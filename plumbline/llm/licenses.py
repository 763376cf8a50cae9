"""License scan by diagonal voting (all native).

Every rolling word k-gram of every document is joined to the k-grams of the templates. A hit votes for the diagonal
(place in the document minus place in the template); votes are merged over neighbouring diagonals, so that a few words
more or less do not break a match, and a span counts when enough of the template lies in it. Islands of neighbouring
diagonals may be far longer than the template, as after many repeats of its words; every window of the template's length
in them is verified. A phrase must lie on one diagonal as a whole, which is where its words stand consecutively.

Defined cases: null or empty text has no words, no labels and score 0; rows equal in id and text are matched once and
returned each; overlapping places all count; an empty table gives an empty result; other columns are ignored. Words are
compared by 64-bit hashes of k-grams, on all k-grams of the template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, texts, words_of, written

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
DRIFT = 4              # diagonals this close belong to one place
COVERAGE = 0.6         # part of a template's k-grams that a span must hold


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrase: bool = False   # wanted word by word
    base: bool = False


# Wordings of well-known public licences, lower case, without punctuation.
TEMPLATES = (
    Template("mit", "under the mit license", phrase=True, base=True),
    Template("apache-2", "apache license version 2", phrase=True, base=True),
    Template("cc-by-nc", "cc by nc", phrase=True, base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-3", "gnu general public license version 3", phrase=True),
    Template("gpl-2", "gnu general public license version 2", phrase=True),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license", phrase=True),
    Template("agpl", "gnu affero general public license", phrase=True),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted"),
    Template("mpl-2", "mozilla public license version 2", phrase=True),
    Template("cc-by-sa", "cc by sa", phrase=True),
    Template("cc-by-nd", "cc by nd", phrase=True),
    Template("cc-by", "creative commons attribution", phrase=True),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", phrase=True),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """tpl, t_pos, h, n_grams: one row per k-gram of a template (at most 64 each, so votes fit into one long)."""
    rows = []
    for i, t in enumerate(templates):
        ws = t.words.split()
        if not K <= len(ws) <= 63 + K:
            raise ValueError(f"a template has {K} to {63 + K} words: {t.words!r}")
        rows += [(i, j, len(ws) - K + 1, *ws[j:j + K]) for j in range(len(ws) - K + 1)]
    df = spark.createDataFrame(rows, "tpl int, t_pos int, n_grams int, a string, b string, c string")
    return df.select("tpl", "t_pos", "n_grams", F.xxhash64("a", "b", "c").alias("h"))


def places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE,
           drift: int = DRIFT) -> DataFrame:
    """doc_id, text_key, tpl, start, end, coverage: the verified spans, in words from 0 (end is exclusive)."""
    spark = docs.sparkSession
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), words_of(LICENSE_WORD, lowered()).alias("ws"))
    grams = rows.filter(f"size(ws) >= {K}").select("doc_id", "text_key", F.posexplode(F.expr(
        f"transform(sequence(0, size(ws) - {K}), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))")).alias("pos", "h"))
    # The templates are constants of this module, so the broadcast side has a fixed size.
    hits = grams.join(F.broadcast(template_grams(spark, templates)), "h")
    votes = hits.groupBy("doc_id", "text_key", "tpl", "n_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, t_pos)")).alias("mask"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    votes = written(votes, "votes")    # read twice below; few rows, as most k-grams hit nothing
    exact = [i for i, t in enumerate(templates) if t.phrase]
    phrase = votes.filter(F.col("tpl").isin(exact) & (F.bit_count("mask") == F.col("n_grams"))).select(
        "doc_id", "text_key", "tpl", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + K - 1).alias("end"),
        F.lit(1.0).alias("coverage"))
    key = "doc_id, text_key, tpl"
    loose = votes.filter(~F.col("tpl").isin(exact)).withColumn("fresh", F.expr(
        f"if(diagonal - lag(diagonal) over (partition by {key} order by diagonal) <= {drift}, 0, 1)"))
    loose = loose.withColumn("island", F.expr(f"sum(fresh) over (partition by {key} order by diagonal)"))
    # A copy of the template spreads over fewer diagonals than it has words, so every place begins a window that wide.
    reach = max((len(t.words.split()) for t in templates), default=K) - 1
    loose = loose.withColumn("near", F.expr(
        f"filter(collect_list(struct(diagonal, mask, lo, hi)) over (partition by {key}, island order by diagonal range between current row "
        f"and {reach} following), v -> v.diagonal < diagonal + n_grams + {K - 1})"))
    found = loose.withColumn("coverage", F.expr("bit_count(aggregate(near, 0L, (a, v) -> a | v.mask)) / n_grams")).filter(F.col("coverage") >= coverage)
    # Of the windows that begin within a template's length of each other, the best one is the place, the first of equals.
    beside = ("collect_list(struct(diagonal, coverage)) over (partition by doc_id, text_key, tpl, island order by diagonal "
              f"range between {reach} preceding and {reach} following)")
    found = found.withColumn("beside", F.expr(
        f"filter({beside}, v -> abs(v.diagonal - diagonal) < n_grams + {K - 1} and "
        "(v.coverage > coverage or (v.coverage = coverage and v.diagonal < diagonal)))")).filter("size(beside) = 0")
    merged = found.select("doc_id", "text_key", "tpl", F.expr("array_min(transform(near, v -> v.lo))").alias("start"),
                          (F.expr("array_max(transform(near, v -> v.hi))") + K).alias("end"), "coverage")
    return phrase.unionByName(merged)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of `docs`."""
    found = places(docs, templates)
    names = docs.sparkSession.createDataFrame([(i, t.label, t.base) for i, t in enumerate(templates)], "tpl int, label string, base boolean")
    per_doc = found.join(F.broadcast(names), "tpl").groupBy("doc_id", "text_key").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("b"), F.collect_set("label").alias("l"),
        F.max("coverage").alias("score"))
    per_doc = per_doc.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), "n_base", "first_word", "last_word", "b", "l", "score")
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words_of(LICENSE_WORD, lowered())).cast("long").alias("n_words"))
    rows = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                       F.col("first_word").cast("long"), F.col("last_word").cast("long"),
                       listed("b").alias("base_labels"), listed("l").alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))
