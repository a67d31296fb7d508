"""A corpus pipeline of five stages over documents; each returns what the next one reads.

quality: documents that a quality rule rejects go. near_copies: of each group
of linked documents the smallest doc_id stays. repeats: words of repeated
20-word passages go; a document of which nothing is left goes. leaks: documents
that hold a window of a benchmark item go. pack: the rest, as pieces of
sequences of at most 4096 tokens.

Each stage works on all its predecessor kept and defines its results for null
and empty texts, ties, repeated rows and empty tables as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontamination, jaccard, packing, quality, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_texts(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("pack", pack)]

#: Connected components, token ids and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each written to the shared folder and read back."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
