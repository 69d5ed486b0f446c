"""The corpus pipeline: five stages over ``documents``, each reading the Parquet that its predecessor wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of documents.  ``run`` applies them in order, writing each result under the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.llm import bpe, decontaminate, linededup, simhash, toxicity
from tripflow.llm.common import prepare, table
from tripflow.llm.queries import JSON_VOCABULARY
from tripflow.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that repeat an earlier one; n_chars follows the text.  No document goes."""
    prepare(spark)
    return linededup.strip_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, at most two differing bits."""
    prepare(spark)
    return simhash.keep_one(docs, size=3, radius=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the text decoded from them."""
    prepare(spark)
    return bpe.bpe_roundtrip(docs, JSON_VOCABULARY, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_dedup", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("bpe", encode)]

# Learned scores, reachability and token merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
