"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripflow.llm import (bpe, chat, decontaminate, fingerprint, licences, linededup, packing, quality, search, simhash,
                          substring, toxicity, whitening)
from tripflow.llm.common import table

# Where the vocabulary files are; the operators take the paths as parameters.
JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf_dir, "documents"), RANK_VOCABULARY, length=2048)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), size=13)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), JSON_VOCABULARY)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_conversations(rows))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_multiset_fingerprint, op2_toxicity, op3_token_packing, op4_licence_scan, op5_substring_dedup, op6_decontamination,
    op7_simhash_dedup, op8_quality_ranking, op9_line_dedup, op10_bpe_roundtrip, op11_embedding_whitening,
    op12_chat_formatting, op13_ranked_search)}

ORACLE: dict[str, str] = {"op4_licence_scan": licences.oracle(), "op12_chat_formatting": chat.oracle(),
                          "op13_ranked_search": search.oracle()}
