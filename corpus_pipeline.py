"""A corpus pipeline: five stages, each an operator of thicket.llm applied to all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import bpe, classifier, mixing, quality_rules, simhash
from thicket.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rows that fail the base rules or a fertility band go."""
    return quality_rules.filter_docs(docs)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows predicted bad go."""
    return classifier.filter_docs(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of each group the row of the smallest id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each source gives as many words as its weight calls for, by repeats and by passages."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: doc_id, n_tokens, ids_sha256 and decoded_sha256 of each mixed row."""
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", classified),
    ("simhash", deduplicated),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Tokenisers and a fitted classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
