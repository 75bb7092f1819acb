"""Corpus preparation: toxicity, exact dedup, near-duplicate join, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``;
mixing adds ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import Scratch
from granary.llm.decontaminate import drop_contaminated
from granary.llm.exact_dedup import drop_exact_copies
from granary.llm.jaccard_join import drop_near_copies
from granary.llm.mixing import mix_sources
from granary.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 3-word shingles and 0.9, as in op4, the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % or more is benchmark text go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to shares by the square root of their characters, in global random order."""
    return mix_sources(docs).drop("shuffle_key")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram jaccard", near), ("decontamination", decontaminate), ("mixing", mix)]

#: The classifier cannot be expressed in SQL; given its verdicts, tests/llm/test_pipeline.py recomputes run() by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
