"""Exact quantiles of any number of values: distributed order statistics, no sort of all values and no task that holds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators.lineage import cut

#: Ranges that a round's histogram divides a range of values into; wanted ranges at most that are sent to every task.
RANGES, SENT = 1024, 20_000


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by, n, q): the number of values of each group and its quantiles, an array in the order of ``shares``, linearly interpolated as ``percentile`` does.

    Nulls and values that are not finite are left out; a group without others has no row. A quantile lies between two values of known
    ranks. Each round counts the values of every range that holds a wanted rank in a histogram, summed before the shuffle, and goes on in the one
    part where the rank lies, from its smallest to its largest value, until these are one. A range shrinks about a thousandfold a round,
    and repeated values never split, so rounds are few whatever the values.
    """
    v = F.col(value).cast("double")
    rows = cut(df.select(*by, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = cut(stats.where("n > 0"))
    at = [F.lit(p) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[r for p in at for r in (F.floor(p), F.ceil(p))]))
    targets = cut(stats.select(*by, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("before")))
    alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], F.lit(True))
    done = targets.where("lo = hi").select(*by, "k", "lo")
    while (wanted := targets.where("lo < hi").select(*by, "lo", "hi", "before").distinct()).limit(1).count():
        wanted = cut(wanted.withColumnsRenamed({c: f"{c}_" for c in by}))
        sides = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        held = rows.join(sides, alike & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*by, "lo", "hi", "before", "v")
        part = F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES)).alias("b")
        counts = held.groupBy(*by, "lo", "hi", "before", part).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*by, "lo", "hi", "before").orderBy("b"))
        counts = counts.withColumn("upto", F.col("before") + upto).withColumnsRenamed({c: f"{c}_" for c in (*by, "lo", "hi", "before")})
        open_ = targets.where("lo < hi")
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*by, "lo", "hi", "before")])
        step = open_.join(counts, on & (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
        targets = cut(step.select(*by, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("c")).alias("before")))
        done = done.unionByName(targets.where("lo = hi").select(*by, "k", "lo"))
    known = done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "lo"))).alias("at")).withColumnsRenamed({c: f"{c}_" for c in by})
    both = stats.join(known, alike)

    def between(p):
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return both.select(*by, "n", F.array(*map(between, at)).alias("q"))
