"""A training corpus from raw documents: low quality and near-duplicates go, secrets are
masked, sources are mixed to their weights, and texts become token ids.

``run`` applies STAGES to ``documents``. Each stage reads what the one before wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import bpe, mixing, quality, secrets, simhash
from skyframe.llm.common import table
from skyframe.llm.queries import tokenizer_path
from skyframe.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in the order of training."""
    return mixing.training_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their whole text in place of it."""
    found = bpe.encode_documents(docs, tokenizer_path())
    return found.select(*[c for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", masked_secrets),
    ("source_mixing", mixed_sources),
    ("bpe_encoding", token_ids),
]

#: SQL can express none of the models and encoders; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
