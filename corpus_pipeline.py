"""Training-data pipeline over documents: five stages, each written and read again.

Every stage takes all rows that its predecessor kept, and its decisions take effect: toxic
documents go, one document of each group of near-duplicates stays, documents that hold a benchmark
item go, personal data is replaced in the text, and what is left is encoded. All stages but the
last return the columns of ``documents``.

Defined results: a null text is kept as it is by all filters (it is neither toxic, nor a copy, nor
a leak) and encodes to no ids. Of rows that share a key, those that a filter names go together,
except for near-duplicates: there, one row of the smallest key of each group stays, and rows with a
null key stay only if nothing else is in their group, one of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry.llm import decontam, neardup, pii, toxicity
from codexferry.llm import queries as Q
from codexferry.llm.common import table
from codexferry.storage import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score is 0.5 or more."""
    model = Q.toxicity_model(docs, spark, sf_dir)
    return toxicity.clean(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, a similarity of 0.8 or more."""
    return neardup.deduplicated(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontam.clean(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.pseudonymized(docs, Q.PII_KEY).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, decoded again: their number and both digests."""
    return Q.byte_bpe(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encode_stage),
]

#: Nearest neighbours, surrogates and byte-pair merges have no SQL form; tests hold brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
