"""The corpus pipeline: stages over documents, each one of the corpus operators with production parameters.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from loam.llm.common import staged, unstage


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the labels know, go; a language that is missing is filled in."""
    return language_id.keep_identified(docs, language_id.fit(docs, folds=4, held=2))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays. No contract fixes this stage's
    parameters, so they are those of word-shingle stages: five words, similarity 0.8."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, repeats=2)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", tokenise)]

#: The first stage is a trained model, and the last one has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table gives none. A stage's result is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        unstage(before)
    return docs
