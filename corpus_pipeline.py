"""Pipeline of training-data operators over ``documents``: quality classifier,
SimHash near-dedup, redaction of personal data, mixing of sources to target
weights, and packing into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.llm import mixing, packing, pii, quality_net, simhash
from recordchecks.llm.common import read_table, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    return quality_net.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 3-word SimHash near-duplicates at 3 bits or fewer."""
    return simhash.deduplicated(docs, shingle=3, max_bits=3)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks and ``n_chars`` brought in step."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the entropy-balanced mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("private_data", private_data), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None  # the stages hold trained models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over all that its predecessor kept."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
