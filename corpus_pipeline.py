"""The corpus pipeline: documents in, sharded and mixed training documents out.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents, whatever further ones there are; the last replaces those named like its results.

Defined results: a document without text, or with an empty one, passes all stages once; one without doc_id is
linked with nothing; repeated rows are near copies of each other by id, so they stay or go together; rows that
repeat an id with other texts stay if one of them does; empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontam, mixing, near_dedup, sharding, toxicity
from docquarry.session import importable, new_path, saved, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    importable(spark)
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, toward the sources' targets."""
    importable(spark)
    return mixing.repeated(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, shards near equal in bytes."""
    importable(spark)
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL expresses none of a fitted model, groups of near copies and the draws of a mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage saves on its way is deleted once its documents are written
            docs = saved(stage(spark, docs, sf_dir), name, path)
    return docs
