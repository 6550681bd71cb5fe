"""A corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last keep the
columns of documents and drop the rows they reject; the last returns the
pieces of packed sequences with the source of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, ngram_join, packing, quality, toxicity

#: Words that packing's encoder remembers: its workers have the traces of three stages before.
REMEMBERED = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality passes."""
    return quality.filter_documents(docs)


def toxicity_models(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by models of this stage's labelled documents."""
    return toxicity.filter_documents(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its runs of five words."""
    return ngram_join.filter_documents(docs, n=5, percent=80)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens in the corpus's own mixture of sources."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_models),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", mixture_packing),
]

#: Expectation-maximisation, models and merges have no SQL form. The tests hold each stage's rows against plain loops over its whole input, with the operators' fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
