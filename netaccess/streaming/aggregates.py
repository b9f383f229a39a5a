"""Streaming counterparts (an extension): windowed sums with late data, and access classes on a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators import access


def windowed_sums(stream: DataFrame, time: str, by: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums and counts by tumbling window and keys; data later than the watermark is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.sum(value).alias("total"), F.count("*").alias("rows")).select(F.col("window.start").alias("start"), *by, "total", "rows")


def classified(stream: DataFrame, budget: float) -> DataFrame:
    """Stateless classification: the same columns as in batch."""
    return stream.select("*", *[f.alias(k) for k, f in access.classes(F.col("metro_d"), F.col("bus_d"), budget).items()])
