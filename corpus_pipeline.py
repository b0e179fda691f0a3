"""Corpus pipeline: quality rules, near-duplicate join, secret scan, mixing, packing.

Every stage reads what the stage before it kept, written as Parquet in the shared folder, and
its decisions take effect: rejected documents go, one document of each group of near-duplicates
stays, secrets are replaced in the text, documents are left out or repeated by their rate, and
the rest is packed into sequences. All but the last return the columns of documents.

Null, empty and wordless texts fail the first stage's least number of words. Rows that repeat an
id and text, and rows with a null id whose class has another, go in the second. Texts of any length
are handled whole, further columns of any name stay until the last stage, empty tables give empty
results, and without labels every rate is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import mixing, ngram_join, packing, quality, secrets
from treeloom.llm.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the default policy."""
    return quality.apply_policy(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of texts linked by five-word Jaccard of 0.8 or more."""
    return ngram_join.keep_one(docs, ngram_join.classes(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates that meet the domain targets say."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot tokenize, and the mixing stage is iterative; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
