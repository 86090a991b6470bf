"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cantera.llm import decontaminate, mixing, ngram_join, quality, sharding
from cantera.llm.shared import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    A null text scores as an empty one; every row is scored by itself, repeated ones too; an
    empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, then text hash, of each group of near duplicates.

    Rows that repeat id and text are one document; a null id comes last; documents without
    words are like no other and stay.
    """
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go.

    Null and empty texts, and all texts if there are no items, stay as they are; rows are
    looked at one by one.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once or twice each.

    A null source is a source of its own; documents without words are taken once; ties in the
    order of a stream fall by id, then size.
    """
    return mixing.mixed(docs)


def sharding_compaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as target-sized shards, read back from the committed manifest; the same bag of rows, nulls and repeats included."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_compaction),
]

#: The classifier and the automaton aren't SQL; the tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
