"""A corpus pipeline of four stages: each works on all that the one before it kept.

quality rules (rejected documents go) -> near duplicates (one document of each group
stays) -> secret scans (secrets are masked) -> best-fit packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm import grouped_join, packing, quality, secret_scan
from basewright.llm.frames import apart, together
from basewright.llm.queries import BYTE_END, BYTE_VOCABULARY, SEQUENCE
from basewright.sinks.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more on five-word shingles, the one with the least id."""
    return grouped_join.one_of_each(docs, grouped_join.Near(words=5, hundredths=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; `n_chars` follows a text that changes."""
    plain, names = apart(docs)
    text, n_chars = names["text"], names["n_chars"]
    masked = secret_scan.redacted(plain.withColumn("before", F.xxhash64(text)), text)
    changed = F.xxhash64(text) != F.col("before")
    return together(masked, names, **{n_chars: F.when(changed, F.length(text).cast("long")).otherwise(F.col(n_chars))})


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    pieces = packing.pieces_of(docs, BYTE_VOCABULARY, BYTE_END, SEQUENCE)
    return packing.packed(pieces, SEQUENCE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing and packing are beyond SQL; the stages are tested against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
