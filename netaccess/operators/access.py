"""Threshold classification, conditional weighted sums, shares and roll-ups.

All are one pass with a partial aggregation; district and city rows come from one GROUPING SETS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Walking speeds in km/h and the minutes of a walk.
SPEEDS, MINUTES = (4.0, 4.8, 5.6), 10


def budget_m(kmh: float, minutes: float = MINUTES) -> float:
    return kmh * 1000.0 / 3600.0 * (minutes * 60.0)


def within(distance: Column, budget) -> Column:
    """Inclusive, unrounded; NaN and null are never within."""
    return F.coalesce(~F.isnan(distance) & (distance <= budget), F.lit(False))


def known(distance: Column) -> Column:
    """The distance, raising where it is NaN: a cell without a distance must not pass for one out of reach."""
    return F.when(F.isnan(distance), F.raise_error(F.lit("a distance is NaN")).cast("double")).otherwise(distance)


def classes(metro: Column, bus: Column, budget) -> dict[str, Column]:
    """The exclusive partition: metro, bus_only, underserved. A NaN distance raises; null is unreached."""
    m, b = within(known(metro), budget), within(known(bus), budget)
    return {"metro": m, "bus_only": ~m & b, "underserved": ~m & ~b}


def share(part: Column, whole: Column) -> Column:
    """Percent; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def rate(part: Column, whole: Column, per: float = 1.0) -> Column:
    """Null where the whole is not positive."""
    return F.when(whole > 0, part * F.lit(per) / whole)


def partition_sums(cells: DataFrame, budget, by: list[str], weight: str = "weight") -> DataFrame:
    """Weights of the three classes and the total by group, with percentages."""
    c = classes(F.col("metro_d"), F.col("bus_d"), budget)
    sums = [F.sum(F.when(f, F.col(weight)).otherwise(0)).alias(k) for k, f in c.items()]
    return cells.groupBy(*by).agg(F.sum(weight).alias("total"), *sums)


def with_shares(df: DataFrame, parts=("metro", "bus_only", "underserved"), digits: int = 6) -> DataFrame:
    return df.select("*", *[F.round(share(F.col(p), F.col("total")), digits).alias(f"{p}_pct") for p in parts])


def city_and_groups(cells: DataFrame, budget, group: str = "district", weight: str = "weight") -> DataFrame:
    """The same for every group and for all, marked by scope; one aggregation (GROUPING SETS)."""
    c = classes(F.col("metro_d"), F.col("bus_d"), budget)
    rows = cells.select(F.col(group), F.col(weight).alias("w"), *[f.alias(k) for k, f in c.items()])
    sums = [F.sum(F.when(F.col(k), F.col("w")).otherwise(0)).alias(k) for k in c]
    out = rows.groupingSets([[group], []], group).agg(F.when(F.grouping(group) == 0, "district").otherwise("city").alias("scope"), F.sum("w").alias("total"), *sums)
    return with_shares(out)


def by_speed(cells: DataFrame, speeds=SPEEDS, group: str = "district") -> DataFrame:
    """Groups and all for each speed; distances are reused, so the cells are read once and expanded by the speeds."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("speed_kmh"), F.lit(budget_m(s)).alias("budget")) for s in speeds]))
    wide = cells.withColumn("s", pairs).select(group, "weight", "metro_d", "bus_d", "s.speed_kmh", "s.budget")
    c = classes(F.col("metro_d"), F.col("bus_d"), F.col("budget"))
    sums = [F.sum(F.when(f, F.col("weight")).otherwise(0)).alias(k) for k, f in c.items()]
    sets = wide.groupingSets([["speed_kmh", "budget", group], ["speed_kmh", "budget"]], "speed_kmh", "budget", group)
    out = sets.agg(F.when(F.grouping(group) == 0, "district").otherwise("city").alias("scope"), F.sum("weight").alias("total"), *sums)
    return with_shares(out).withColumn("budget_m", F.round("budget", 4)).drop("budget")


def weighted_access(df: DataFrame, weight: Column, accessible: Column, by: list[str]) -> DataFrame:
    """Denominator and numerator over weights that are neither null nor NaN; percent null where nothing is left. A negative weight raises."""
    w = F.when(weight < 0, F.raise_error(F.lit("a weight is negative")).cast("double")).when(~F.isnan(weight), weight)
    out = df.groupBy(*by).agg(F.sum(w).alias("denominator"), F.sum(F.when(accessible, w).otherwise(F.when(w.isNotNull(), 0.0))).alias("numerator"))
    return out.withColumn("pct", F.round(rate(F.col("numerator"), F.col("denominator"), 100.0), 6))


def overlaps(cells: DataFrame, budget, other: Column, by: list[str]) -> DataFrame:
    """Weights of each class that another destination's mask also covers; shares are of the whole weight."""
    c = classes(F.col("metro_d"), F.col("bus_d"), budget)
    out = cells.groupBy(*by).agg(
        F.sum("weight").alias("total"), F.sum(F.when(other, F.col("weight")).otherwise(0)).alias("covered"),
        *[F.sum(F.when(f & other, F.col("weight")).otherwise(0)).alias(f"{k}_covered") for k, f in c.items()],
    )
    return out.select("*", *[F.round(share(F.col(f"{k}_covered"), F.col("total")), 6).alias(f"{k}_covered_pct") for k in c])
