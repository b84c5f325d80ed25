"""The corpus pipeline: STAGES over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyvec.llm import mixing, near_dup, quality, sp_codec, toxicity
from polyvec.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that lose too much by it."""
    return quality.cleaned(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic noisy-or score go; the model is trained on the labelled ones of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows cut at the exact budget or repeated by epochs."""
    return mixing.mixture(docs, whole=True)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip."""
    return sp_codec.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: Two stages (a trained model, token ids) are not expressible in SQL: tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents: doc_id, n_ids, ids, round_trip of every row of the mixture.

    Each stage reads what the one before it wrote, and defines odd cases as its operator does: null,
    empty and wordless texts go with the quality rules, so that later stages see none; null doc_ids,
    sources and other columns pass through, a null source being one of its own; rows that repeat a
    doc_id are one document from the near-duplicates on, null ids excepted. Of ties the first or least
    stays, as each operator says. Very long texts are treated whole. documents may have further
    columns with any names, which stay up to the last stage. An empty table gives no rows. Tables
    between stages are dropped once they were read; the last one goes when the application ends.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
