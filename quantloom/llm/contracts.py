"""The thin queries: each reads its table, calls its operator and derives the columns it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, ngram_join, packing, pii, runindex, sharding, substrings, toxicity, warc
from ._text import shared_dir
from .contracts_params import SHARD_BYTES
from .oracles import ORACLE  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.versions(_read(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_words(_read(spark, sf_dir, "documents"), k=50).drop("kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_read(spark, sf_dir, "pages"), shared_dir(spark, "archives"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "intact")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.drop_repeated_bytes(_read(spark, sf_dir, "documents"), k=100).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: all but the held-out fifth of the ids."""
    return _read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training_labels(spark, sf_dir))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted", F.size("passages").alias("n_passages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprint, op2_substring, op3_pii, op4_ngram_join, op5_sharding, op6_warc, op7_suffix_array, op8_decontamination, op9_toxicity, op10_packing)
}
