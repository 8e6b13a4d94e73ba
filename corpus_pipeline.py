"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the stage before it kept, written as Parquet
and read again, and returns those it keeps itself; the last packs them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, packing, quality_rules, secret_scan, simhash_dedup
from orbweave.llm.common import discard, materialise, read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality_rules.quality_rules(docs, read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also an edited one, go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are written over with their kind; all documents stay."""
    found = secret_scan.find_secrets(docs, out="__spans")
    text = secret_scan.redact(F.col("text"), F.col("__spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids and their places in sequences."""
    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what a stage wrote goes once its result is whole."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            kept = materialise(stage(spark, docs, sf_dir), f"stage-{k}", keep=True)
        discard(docs)
        docs = kept
    return docs


#: SQL cannot express fingerprint groups, alignments or token ids.
ORACLE_SQL = None
