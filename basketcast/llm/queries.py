"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.llm import (bm25, byte_bpe, divergence, fingerprint, lm_score, mixing, ngram_join, ordinal, packing, pfp,
                            rendezvous, repair, secrets)

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_layers")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BPE_JSON, PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 2: good and not toxic, one less for each flaw; kept if grade 2 is at least as likely as not."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = (labels.where("quality IN (0, 1) AND toxic IN (0, 1)")
               .select(F.col("doc_id").cast("long"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")))
    docs = documents(spark, sf_dir)
    return ordinal.grade(docs, ordinal.train(docs, ratings, 3), wanted=2)


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, whole; against all documents."""
    return bm25.search(documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_dedup(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_records(documents(spark, sf_dir), [1.0] * SHARDS).withColumnRenamed("key", "doc_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), BPE_RANKS, PATTERN)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; as many words as all documents have, 16 shards."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the fixed damage: its faults and its cheapest repair."""
    hurt, lost = repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair.repair_conversations(hurt, dropped=lost)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_repeat_removal": op4_repeat_removal,
    "op5_topk_search": op5_topk_search,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_lm_score": op9_lm_score,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_mix": op11_source_mix,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}
