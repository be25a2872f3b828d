"""The corpus pipeline: five stages that each call one operator of ``opsframe.llm``, in order.

Toxic documents go; of each group of near-duplicates one stays; byte strings that repeat are cut out; documents with benchmark
passages go; the rest is mixed by source. Each stage works on all rows that its predecessor kept and returns the columns of
``documents``; the last adds how often a document is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, read
from opsframe.llm.decontaminate import drop_leaks
from opsframe.llm.mixing import take
from opsframe.llm.simhash import keep_one
from opsframe.llm.suffix_dedup import without_repeats
from opsframe.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on their labels, doesn't reject."""
    return drop_toxic(docs.select(*COLUMNS), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest doc_id."""
    return keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 200 bytes found elsewhere too cover; n_chars follows the text."""
    return without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage."""
    return drop_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``) and their words times that (``taken``)."""
    return take(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses none of trained scores, suffix sorting and balanced sampling; tests/llm/test_pipeline.py holds the stages to brute force.
ORACLE_SQL = None
