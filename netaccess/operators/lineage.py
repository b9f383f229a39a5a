"""Cutting lineage in iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own checkpoint folder.

    Where neither is set, a session of one machine (tests) gets a temporary folder; a cluster is refused,
    as no folder of one machine is seen by the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="netaccess-"))
        folder = context.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """A checkpoint dealt out by keys and sorted by them, that joins on these keys read as it lies; that of an adaptive plan forgets how its rows are dealt."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, was)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for loops of joins.

    A checkpoint keeps the estimate of its size, and a join multiplies those of its sides: after some twenty rounds these numbers have
    millions of digits and planning takes minutes. A table's size is that of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
