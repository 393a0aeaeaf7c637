"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents, whatever else they are called. Null and empty texts and null doc_ids pass through
every filter but the classifier, which scores a text without words like any other; rows that repeat a doc_id are judged by their own texts,
except that near-dedup keeps or drops all rows of a doc_id together. Ties go to the smaller doc_id. Texts may have any length, tables may be
empty; without labels of two grades the classifier keeps all.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import lines, minhash, packing, quality, suffixes
from assayer.llm.lineage import shared_folder, shrink

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _on_small_heaps(stage: Stage) -> Stage:
    """Stages run in the same executors, one after another, and each begins with heaps of its own size."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run


@_on_small_heaps
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on labels, keeps: those that are more likely good than not."""
    return quality.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_on_small_heaps
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that stand in an earlier document; documents of which nothing is left go."""
    return lines.deduplicated(docs)


@_on_small_heaps
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return minhash.deduplicated(docs)


@_on_small_heaps
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes in 400-byte strings that occur elsewhere; documents of which nothing is left go."""
    return suffixes.deduplicated(docs)


@_on_small_heaps
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, in pieces, and the bins that they fill; a null or empty text is a piece without a bin."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, the chunker or the packing; operators are tested against brute force, stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
