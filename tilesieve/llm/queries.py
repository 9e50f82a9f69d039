"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilesieve.llm import license_index, media_chunks, mixing, packing, quality_qda, quality_rules, revisits, sentence_spans, simhash_pivots, toxicity
from tilesieve.llm.common import table
from tilesieve.llm.oracles import ORACLES


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_stats(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.revisited_pages(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_report(table(spark, sf_dir, "documents"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op4_toxicity": op4_toxicity,
    "op5_license_index": op5_license_index,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_quality_qda": op7_quality_qda,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_media_chunks": op9_media_chunks,
    "op10_source_mixing": op10_source_mixing,
}
