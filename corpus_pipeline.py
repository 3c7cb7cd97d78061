"""A corpus from raw documents to token ids, in five stages that each keep whole rows.

Each stage reads what its predecessor kept.  All but the last return the columns of documents; the last returns
doc_id and the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from veilframe.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one document of each group stays; five words, similarity 0.8 or more."""
    return jaccard_join.deduplicated(docs, k=5, p=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents drawn by their calibrated probabilities."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding, checked by decoding."""
    return pieces.encoded(docs)


STAGES = [
    ("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("mixing", mix), ("encoding", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
