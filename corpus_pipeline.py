"""The corpus pipeline: documents -> filtered, deduplicated, redacted, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Part of the training-data operators.

Defined results, stage by stage: a null or empty text has no words and fails the quality rules; labels
that are null teach nothing. Rows that are equal in doc_id and text are one document in near duplicates,
a null doc_id is kept last, rows without words are linked with nothing. Secrets and BPE treat each row
alone, a null text as it is. Mixing takes a null source as one of its own, takes rows without words
never, and rows that are wholly equal alike. An empty table passes through every stage as an empty one;
columns beside those of ``documents`` are left out at the start of ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walkmoments.llm import bpe, mixing, ngram_join, quality, secrets
from walkmoments.llm.common import DOC_COLUMNS, materialize

#: Near duplicates share five-word shingles to a similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 8, 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*DOC_COLUMNS), labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id."""
    return ngram_join.keep_one(docs, WORDS, NUM, DEN)


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked in the texts; n_chars follows."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated so that each source's words come near its target."""
    return mixing.repeat_to_targets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests."""
    return bpe.round_trip_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", redacted_secrets),
    ("mixing", mixed_sources),
    ("BPE", encoded),
]

#: Learned lists, similarity components and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOC_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
