"""Comparison of two weight surfaces, grids and distribution summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.operators.lineage import cut
from netaccess.operators.quantiles import exact_quantiles

QUANTILES = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0)


def compare(a: DataFrame, b: DataFrame, key: str, floor: float = 0.05, near: float = 0.1) -> DataFrame:
    """One row: validity counts, correlation, least-squares scale, ratios and residuals of b against a.

    Columns (key, value) each; a key on one side only is valid there only. Two passes over the joined
    surfaces, the second because residuals need the scale.
    """
    j = a.select(key, F.col("value").alias("a")).join(b.select(key, F.col("value").alias("b")), key, "full").select("a", "b")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    ratio = F.when(both & (F.col("a") > floor), F.col("b") / F.col("a"))
    pa, pb = F.when(both, F.col("a")), F.when(both, F.col("b"))
    j = cut(j.select("a", "b", ratio.alias("ratio")))  # read again for the quantiles and the residuals
    one = j.agg(
        F.count_if(both).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
        F.corr(pa, pb).alias("r"), (F.sum(pa * pb) / F.sum(pa * pa)).alias("k"), (F.sum(pb) / F.sum(pa)).alias("total_ratio"),
    )
    one = cut(one.join(exact_quantiles(j, "ratio", list(QUANTILES), []).select("q"), how="left"))  # one row each
    rest = F.abs(F.col("b") - F.col("k") * F.col("a"))
    # the first aggregate is one row
    scaled = j.where(both).crossJoin(F.broadcast(one.select("k", F.col("q")[3].alias("median")))).withColumn("rest", rest)
    two = scaled.agg(
        F.avg("rest").alias("mae"), F.max("rest").alias("max_residual"),
        (F.sqrt(F.avg(F.col("rest") * F.col("rest"))) / F.avg("b")).alias("nrmse"), (F.sum("rest") / F.sum("b")).alias("relative_l1"),
        F.avg(F.when(F.col("a") > floor, F.when(F.abs(F.col("b") / F.col("a") - F.col("median")) <= near * F.col("median"), 1.0).otherwise(0.0))).alias("near_median"),
    ).join(exact_quantiles(scaled, "rest", [0.5], []).select(F.col("q")[0].alias("median_residual")), how="left")
    r = lambda c: F.round(c, 6).alias(c)
    out = one.crossJoin(F.broadcast(two))
    return out.select("common", "only_a", "only_b", *[r(c) for c in ("r", "k", "total_ratio", "mae", "median_residual", "max_residual", "nrmse", "relative_l1", "near_median")], *[F.round(F.col("q")[i], 6).alias(f"ratio_p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def summary(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Count, min, mean, median, p95, p99 and max of finite values; infinite ones are counted apart."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    q = df.groupBy(*by).agg(
        F.count(finite).alias("finite"), F.count_if(F.abs(value) == float("inf")).alias("infinite"), F.min(finite).alias("lo"), F.avg(finite).alias("mean"), F.max(finite).alias("hi"),
    )
    at = exact_quantiles(df.select(*by, finite.alias("finite_value")), "finite_value", [0.5, 0.95, 0.99], by).withColumnsRenamed({c: f"{c}_" for c in by}).drop("n")
    q = q.join(at, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], F.lit(True)), "left")
    r = lambda c, n: F.round(c, 4).alias(n)
    return q.select(*by, "finite", "infinite", r(F.col("lo"), "min"), r(F.col("mean"), "mean"), r(F.col("q")[0], "median"), r(F.col("q")[1], "p95"), r(F.col("q")[2], "p99"), r(F.col("hi"), "max"))


def density_grid(points: DataFrame, size: float = 500.0) -> DataFrame:
    """Sums by square of the grid, squares without weight left out, and the weight per square kilometre."""
    bins = points.groupBy(F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).agg(F.sum("weight").alias("weight"), F.count("*").alias("cells"))
    return bins.where("weight > 0").withColumn("density_km2", F.round(F.col("weight") / ((size / 1000.0) ** 2), 6))
