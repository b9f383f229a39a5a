"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding (part of the llm subpackage).

Every stage takes null and empty texts, repeated rows, empty tables and columns of any name; what each does with
them is in the docstrings of the operators it calls. Documents without words are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netaccess.llm import decontaminate, mixing, neardup, quality, sharding
from netaccess.llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer keeps."""
    return quality.filter_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (similarity 0.8 or more), the one with the smallest id."""
    return neardup.deduplicate(docs, threshold=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents plus size, old_shard, shard (0 to 7) and slot; columns of these names are replaced."""
    return sharding.reshard(docs, docs.columns, shards=8)


#: Each function takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shard),
]

#: SQL cannot express the stages (trained models, a flow); they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table in the shared folder, deleted once the next one is there."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs
