"""The named queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import alignment, common, divergence, fingerprints, language, ngram_join, packing, pii, quality, sentencepieces, templates, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(common.table(spark, sf_dir, "documents")))


@query
def op2_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(common.table(spark, sf_dir, "documents"))


@query
def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(common.table(spark, sf_dir, "documents"))


@query
def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.table(spark, sf_dir, "documents")).drop("votes", "quality")


@query
def op5_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(common.table(spark, sf_dir, "pages"))


@query
def op6_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.table(spark, sf_dir, "documents"))


@query
def op7_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.normalise(warc.write_archives(warc.with_revisits(common.table(spark, sf_dir, "pages"))))
    return warc.read_records(archives).drop("url", "intact")


@query
def op8_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(common.table(spark, sf_dir, "documents"), n=3, percent=90).drop("n_links")


@query
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents")).drop("source")


@query
def op10_toxicity_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query
def op11_postings_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(common.table(spark, sf_dir, "documents"))


@query
def op12_semi_markov_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.AUDIT_SQL


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
