"""A training corpus from raw documents, stage by stage; each stage works on all that the one before kept.

Stages but the last return the columns of `documents`, and extra columns as they are. A row with a null doc_id goes through
the filters like any other. A null or empty text has no language and goes first; very long texts are judged whole. Repeated
rows stay together until near_duplicates, which keeps one row of a doc_id, the one with the least text. An empty table gives
an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, ngram_join, packing, quality, suffix_dedup
from ledgerloom.llm.base import cut, table, tune
from ledgerloom.llm.queries import tokenizer_path

#: A document goes if no language was found or the best one has less than this share of its words; words in no learned
#: language count among them, and an even mixture of two or more lies below.
LEAST_LANGUAGE_SHARE = 0.55


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a main language (even mixtures, unlearned languages, letter junk), go."""
    tune(spark)
    return langid.keep_identified(docs, langid.fit(docs), LEAST_LANGUAGE_SHARE)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own and whose site's evidence make good quality less likely than not go."""
    tune(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (one row of it)."""
    tune(spark)
    return ngram_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that an earlier document has too are cut out; documents left without text go."""
    tune(spark)
    return suffix_dedup.cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    tune(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, shingle classes and byte spans are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
