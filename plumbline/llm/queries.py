"""One query per operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from . import (chat, checks, licenses, merkle, packing, quality_gam, quality_rules, resampling, setsketch, simhash, spotsigs, toxicity,
               unigram, warc)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


PLANTED_CHAT = -7


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return quality_rules.judge(read(spark, sf_dir, "documents"), quality_rules.trusted_ids(labels))


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(PLANTED_CHAT, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))],
                                    "conv_id bigint, turn bigint, role string, text string")
    rendered = chat.render(chat.fold(chat.as_log(said.unionByName(planted))))
    return chat.digests(chat.parse(rendered))


_ESCAPED = (r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', "
            r"'\1\\\2\3', 'g')")
CHECKS["op2_chat_format"] = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN + chat.CLOSE) + 1} + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")})
      + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


@_query
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


@_query
def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(read(spark, sf_dir, "documents"))


@_query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


@_query
def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.components(read(spark, sf_dir, "documents"))


CHECKS |= {"op11_importance_resampling": checks.RESAMPLING, "op12_merkle_manifest": checks.MERKLE, "op13_setsketch": checks.NEAR}
