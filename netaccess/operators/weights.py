"""Calibration of fine-grained weights to control totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators.lineage import cut


def calibrate(raw: DataFrame, control: DataFrame, keys: list[str], value: str = "raw", total: str = "control") -> DataFrame:
    """Adds factor (control over the group's sum) and calibrated (value times factor).

    The groups' sums are aggregated before the join, so a group with very many rows is neither windowed in
    one task nor shuffled whole: rows meet one small row for each group. Raises where a group has no control total, a
    control no rows, or a sum is not positive: nothing is left out, so the totals are conserved.
    """
    sums = raw.groupBy(*keys).agg(F.sum(value).alias("_sum")).join(control.select(*keys, F.col(total).alias("_control")), keys, "full")
    factors = cut(sums)
    wrong = F.when(F.col("_control").isNull(), "no control").when(F.col("_sum").isNull(), "no rows").when(~(F.col("_sum") > 0) | F.isnan("_sum"), "no positive sum")
    bad = factors.withColumn("_wrong", wrong).where("_wrong IS NOT NULL").limit(5).collect()  # a few to name
    if bad:
        raise ValueError("; ".join(f"{[r[k] for k in keys]}: {r['_wrong']}" for r in bad))
    return raw.join(factors.select(*keys, (F.col("_control") / F.col("_sum")).alias("factor")), keys).withColumn("calibrated", F.col(value) * F.col("factor"))


def missing_controls(raw: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side: both must be empty for a calibration to conserve."""
    a, b = raw.select(*keys).distinct(), control.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing", F.lit("control")).unionByName(b.join(a, keys, "left_anti").withColumn("missing", F.lit("raw")))
