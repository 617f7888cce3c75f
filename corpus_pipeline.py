"""A corpus for training in five stages: toxic documents out, exact and near copies out, secrets out, packed.

Each stage takes ``(spark, docs, sf_dir)``: the rows its predecessor kept, with
the columns of ``documents``, and the folder of the other tables. All but the
last return those columns again. Repeated ids, nulls in any column, empty texts
and empty tables pass through as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.common import table
from meterloom.llm.exact_dedup import exact_dedup
from meterloom.llm.packing import pack
from meterloom.llm.queries import secret_model, toxicity_model
from meterloom.llm.secrets import redact
from meterloom.llm.simhash import simhash_dedup
from meterloom.llm.toxicity import drop_toxic
from meterloom.session import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below one half."""
    return drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the longest, then smallest id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by fingerprints two bits apart or less, the smallest id."""
    return simhash_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and ``n_chars`` counted anew."""
    clean = redact(docs, secret_model(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: Trained models and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else cut(docs), sf_dir)
    return docs
