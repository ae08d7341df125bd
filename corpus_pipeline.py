"""Corpus pipeline: grade, drop exact copies, drop near copies, redact secrets, pack.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``.  Copies are dropped row by
row, whatever the ids: rows may repeat an id or have none, and of each group one row stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.llm import fingerprint, ngram_join, ordinal, packing, secrets
from basketcast.session import cut_lineage, materialize

GRADES = 3
BATCH_ROWS = 1_000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session whose Arrow batches have at most ``BATCH_ROWS`` rows. A task holds a batch of whole texts
    several times (in the JVM's buffers, as Arrow and as Python strings), so Spark's 10,000 rows weigh on
    every executor. The setting outlives the stage, as its rows are only made when they are written; a smaller one stays."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)
    return run


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 2: good and not toxic; one less for each flaw."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return (labels.where("quality IN (0, 1) AND toxic IN (0, 1)")
            .select(F.col("doc_id").cast("long"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, and the name of that column. A stage's documents are a written
    table, so its rows have the same numbers whenever they are read."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def keep_one(rows: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """``rows`` less all but one of each group in ``groups`` (columns ``member, first``; only of two or more
    rows): the one of smallest id stays, an id before none, then the first row."""
    members = groups.join(rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id")), "member")
    stays = members.groupBy("first").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "member")).alias("m"))
    dropped = members.select("member").join(stays.select(F.col("m.member").alias("member")), "member", "left_anti")
    _, n, side = materialize(dropped.withColumnRenamed("member", "_member"))
    left = rows.join(side, rows[row] == side["_member"], "left_anti") if n else rows
    return left.drop(row)


@in_small_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose probability of the top grade is at least one half."""
    model = ordinal.train(docs, ratings(spark, sf_dir), GRADES)
    return ordinal.select_rows(docs, model, wanted=GRADES - 1)


@in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each group of equal texts."""
    rows, row = numbered(docs)
    found = fingerprint.exact_dedup(rows, id_col=row).where("group_size > 1")
    return keep_one(rows, row, cut_lineage(found.select(F.col("doc_id").alias("member"), F.col("keep_id").alias("first"))))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each component of similar documents."""
    rows, row = numbered(docs)
    found = cut_lineage(ngram_join.near_duplicates(rows, id_col=row)
                        .select(F.col("doc_id").alias("member"), F.col("component_id").alias("first")))
    several = found.where("member <> first")
    firsts = several.select("first").distinct().select(F.col("first").alias("member"), "first")
    return keep_one(rows, row, several.unionByName(firsts))


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret, in plain sight or encoded, by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact_secrets(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

# A fitted classifier, shingle components and tokenizer ids: not for SQL (tests hold run() against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
