"""From raw documents to token files: toxicity, near duplicates, benchmark leaks, source mix, token output.

Every stage works on all that the one before it kept. Its result is written as Parquet to the shared folder and read
again, so a lost executor costs a re-read of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.leaks import without_leaks
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.simhash import one_of_each_group
from tidemark.llm.tokens import tokenized
from tidemark.llm.toxicity import without_toxic
from tidemark.session import settle, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models call toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (op 4: three-word shingles, up to three bits) stays, the one with the smallest id."""
    return one_of_each_group(docs, words=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; a document is there once for each epoch that takes any of it."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and per document what the files hold."""
    return tokenized(docs, shared_folder(spark, "tokens"), end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-id binary output", token_files),
]

#: no stage but the first scan can be put into SQL; the tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
