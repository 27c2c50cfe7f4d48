"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import (
    embedding_dedup,
    language,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)
from lexgrove.llm.shared import cut, fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files, their index, and one record of each payload read back by byte ranges."""
    files = cut(warc.write(_table(spark, sf_dir, "pages"), fresh_path(spark, "warc")))
    return warc.read(warc.select(warc.index(spark, files)))


def op2_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_quality_rules_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op4_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality_classifier_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op6_embedding_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(_table(spark, sf_dir, "embeddings"))


def op7_simhash_bit_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op8_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op9_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_warc_index,
        op2_toxicity_ordinal,
        op3_quality_rules_crf,
        op4_packing_dp,
        op5_quality_classifier_crf,
        op6_embedding_cap_filters,
        op7_simhash_bit_sampling,
        op8_suffix_array_repeats,
        op9_language_centroids,
        op10_source_mixing,
        pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The other queries train models, draw at random or search by hashing; tests hold them against brute force."""
    return {
        "op1_warc_index": """
            SELECT page_id, url, digest, html FROM (
                SELECT page_id, url, html, sha256(coalesce(html, '')) AS digest,
                       row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY url NULLS LAST, page_id NULLS LAST) AS n
                FROM pages)
            WHERE n = 1"""
    }
