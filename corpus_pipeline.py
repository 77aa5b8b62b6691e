"""From documents to tokens: the stages of a training corpus, each a table that the next one reads.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
rereads it as the next stage's docs, and deletes the table before that. All but the last return the columns of documents; the
last adds tokens and n_tokens.

Null and empty texts, and texts without words, are rejected by the first stage. Rows that repeat both doc_id and text are one
document, of which one row stays; rows that share a doc_id only are judged apart. Rows without a doc_id stay, if their text is
good: they are no near duplicate of another and their passages are no copies. Ties go to the least doc_id. Further columns of
documents are kept and never matter, but tokens and n_tokens, which the last stage replaces. Empty tables give empty results;
without labels no document is rejected but those without words. Texts are whole, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import bpe, common, minhash, mixing, quality, substrings


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-labelling field, trained on the labelled ones among docs, doesn't reject."""
    return quality.drop_bad_documents(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and those in none."""
    return minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    return substrings.drop_later_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as docs has, the sources in proportion to the square roots of their documents."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' byte-pair tokens beside their columns."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A conditional random field and sketches can't be stated in SQL: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        common.discard(spark, before)
        before = [f"{folder}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
