"""From documents to packed training sequences, in stages that each call one operator on all rows that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimveil.llm import mixing, packing, quality, secret_scan, simhash
from claimveil.llm.common import fresh_dir, ship, table, unused, word_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least the classifier's threshold; learned from the labels beside the input.

    Null texts are scored like empty ones, very long ones whole; repeated rows and null ids stay if their score does. Columns stay as they are,
    whatever their names; without labels all documents have the same score; an empty table gives none.
    """
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8 or more) one document, that with the smallest doc_id.

    Texts without words, null ones included, are one group. Rows without a doc_id come after all others: they go if their group
    has a document with one, and else one of them stays. Of repeated rows one stays. Very long texts count whole. Columns stay
    as they are, whatever their names; an empty table gives none.
    """
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret in the texts; n_chars follows.

    All documents stay, repeated, very long ones and those without an id or text too, and other columns as they are; an empty table
    gives none.
    """
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each document as many times as the mix takes it; those taken not at all go.

    Rows of one id and size are taken equally often. Null sources are a source; texts without words are not taken, very long ones count whole. Columns
    stay as they are, whatever their names; an empty table gives none.
    """
    key, size, copies = (unused(docs, x) for x in ("mixed_id", "mixed_size", "mixed_copies"))
    mixed = mixing.mix(docs).groupBy(F.col("doc_id").alias(key), F.col("size").alias(size)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    taken = docs.join(mixed, docs.doc_id.eqNullSafe(mixed[key]) & (word_count("text") == mixed[size]))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; repeated documents are packed once for each time.

    Null and empty texts are one piece of one id, very long ones as many pieces as they need; rows without an id are packed as well. An empty table gives none.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the classifier; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
