"""The registered queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from keystrata.llm import bpe, chat, langid, metric, minhash, mixing, quality, sharding, substrings
from keystrata.llm.common import table


LOOSE = 0.35


def op1_word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.word_languages(docs, langid.train(docs))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.document_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(table(spark, sf_dir, "conversations"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))



def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.near_vectors(table(spark, sf_dir, "embeddings"))


def near_vectors_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator at a cosine that vectors without copies have, too."""
    return metric.near_vectors(table(spark, sf_dir, "embeddings"), similar=LOOSE)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.neighbours(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))



def op10_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_word_languages": op1_word_languages,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_document_quality": op3_document_quality,
        "op4_chat_segments": op4_chat_segments,
        "op5_repeated_passages": op5_repeated_passages,
        "op6_mixture": op6_mixture,
        "op7_near_vectors": op7_near_vectors,
        "near_vectors_loose": near_vectors_loose,
        "op8_neighbours": op8_neighbours,
        "op9_bpe": op9_bpe,
        "op10_shuffled_shards": op10_shuffled_shards,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_segments": chat.SEGMENTS_SQL,
        "op5_repeated_passages": substrings.PASSAGES_SQL,
        "op6_mixture": mixing.SAMPLE_SQL,
        "op7_near_vectors": metric.links_sql(metric.SIMILAR),
        "near_vectors_loose": metric.links_sql(LOOSE),
        "op8_neighbours": metric.NEIGHBOURS_SQL,
    }
