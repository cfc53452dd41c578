"""The training-data pipeline: documents in, encoded documents out.

Every stage works on all rows that its predecessor kept, is written as Parquet and read again,
and all but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from docloom.plans.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; texts too short to judge stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.train(docs, labels).filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, in one row; rows without an id
    or without words belong to no group and stay."""
    return ngram_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, benchmark)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay."""
    return secret_scan.mask_secrets(docs, secret_scan.train(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by number and digest, and the digest of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Workers live on into the stages of the next run, which need the memory.
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, remember=False)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("byte_level_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Perplexities, latent vectors and token ids are not SQL; tests compare with plain versions.
ORACLE_SQL = None
