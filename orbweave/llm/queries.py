"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import centroid_clustering, chat_format, decontaminate, embedding_dedup, fill_middle, language_id, license_scan, lm_score, oracles, packing, quality_rules, secret_scan, simhash_dedup, toxicity
from orbweave.llm.common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def remainder(id_col: str) -> Column:
    """The remainder by 5 of the CRC-32 of an id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 5


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("train", remainder("doc_id") != 1)
    scored = lm_score.score_documents(docs)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(read(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id") == 0)
    known = language_id.references(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), known)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digest(chat_format.format_conversations(turns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    measured = quality_rules.materialise(quality_rules.measure(docs).select("doc_id", "lang", "quality"), "quality")
    cutoffs = quality_rules.fit_cutoffs(measured, read(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return quality_rules.judge(measured, cutoffs).select("doc_id", *[f"quality.{k}" for k in base], "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(read(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label quality and one toxicity category; the chain runs from the one to the other."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    return toxicity.score_toxicity(docs, chain).withColumnRenamed("flagged", "toxic")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.digest(*centroid_clustering.cluster_vectors(read(spark, sf_dir, "embeddings")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.format_documents(read(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_packing": op2_packing,
        "op3_lm_score": op3_lm_score,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_language_id": op5_language_id,
        "op6_chat_format": op6_chat_format,
        "op7_quality_rules": op7_quality_rules,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_format": oracles.chat_format_sql(),
        "op7_quality_rules": oracles.quality_sql(),
        "op8_secret_scan": oracles.secret_sql(),
        "op11_centroid_clustering": oracles.clustering_sql(),
        "op12_embedding_dedup": oracles.embedding_dedup_sql(),
        "op13_fill_middle": oracles.fill_middle_sql(),
    }
