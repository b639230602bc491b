"""From raw documents to packed sequences: toxic and near-duplicate documents go, contaminated ones
too, personal data is masked, and the rest is packed.

Every stage works on all rows that it is given and returns none for an empty table.  All but the last keep the
columns, also extra ones; nulls in other columns than ``doc_id`` and ``text`` pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import contracts, decontaminate, ngram_join, packing, pii, toxicity


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go; the model is fitted on the training labels.  Null and
    empty texts stay, repeated rows are judged each."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), contracts.training_labels(spark, sf_dir))
    return toxicity.accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, similarity 0.8) the smallest doc_id stays (a null one is the
    largest), of equal rows one.  Null and empty texts are like nothing and stay."""
    return ngram_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words at least are passages of the benchmark go.  Null and empty texts
    stay, repeated rows are judged each."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, in whole texts of any length; a null text stays null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", civil), ("ngram_join", distinct), ("decontamination", decontaminated), ("pii", private), ("packing", packed)]

#: Classifier, tokeniser and digests are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
