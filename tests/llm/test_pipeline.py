"""The pipeline's stages against their operators' verdicts, and the registered queries."""

from collections import defaultdict

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from plumbline.llm import quality_gam, quality_rules, simhash
from plumbline.llm.common import read

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_classifier"](spark, docs, SF).cache()
    assert ids(one) == ids(quality_gam.score(docs, labels).filter("predicted = 1")) and one.columns == docs.columns
    two = stages["quality_rules"](spark, one, SF).cache()
    assert ids(two) == ids(quality_rules.judge(one, quality_rules.trusted_ids(labels)).filter("kept")) and two.columns == docs.columns
    three = stages["simhash_dedup"](spark, two, SF).cache()
    assert ids(three) == sorted({r["component_id"] for r in simhash.components(two).collect()}) and three.columns == docs.columns
    four = stages["best_fit_packing"](spark, three, SF).collect()
    assert {r["doc_id"] for r in four} == set(ids(three))
    used = defaultdict(int)
    for r in four:
        used[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(used.values()) <= 1024
    run = corpus_pipeline.run(spark, SF)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(keep).collect())) == sorted(tuple(r[c] for c in keep) for r in four)


def test_stages_pass_an_empty_table(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_every_operator_is_registered():
    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in oracle_sql()) for k in (2, 11, 12, 13))
