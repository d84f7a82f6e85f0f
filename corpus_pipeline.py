"""A cleaning pipeline over documents: each stage works on all that the one before it kept.

Stages take and return the columns of documents, but for the last, which returns packed
sequences. Whoever runs them one by one writes each result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stallkeeper.llm import bwt_dedup, near_dup, packing, resampling, secret_scan
from stallkeeper.llm.tables import Stash, load


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has words or repetitions that good documents lack (``resampling.keep_good``; not op3's importance sample)."""
    return resampling.keep_good(docs, load(spark, sf_dir, "labels"), Stash(spark, "pipeline-quality"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near-duplicates."""
    return near_dup.keep_first(docs, Stash(spark, "pipeline-near"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out strings of 200 bytes that occur again."""
    return bwt_dedup.without_repeats(docs, Stash(spark, "pipeline-repeats"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, but for those that so many owners share that they are examples."""
    return secret_scan.redact(docs, Stash(spark, "pipeline-secrets"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every document into sequences of power-of-two lengths."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("packing", pack_sequences),
]

#: Hashed models, permutations and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, writing what each but the last keeps to the shared folder."""
    stash = Stash(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash.put(f"stage-{i}", docs)
            if i:
                stash.drop(f"stage-{i - 1}")
    return docs
