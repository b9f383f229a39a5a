"""Invariants as rows of (check, violations): 0 violations everywhere means the tables hold together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(name: str, df: DataFrame, bad: Column) -> DataFrame:
    """Rows for which ``bad`` holds; null counts as bad."""
    return df.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("violations")).select(F.lit(name).alias("check"), "violations")


def rows_of(name: str, df: DataFrame) -> DataFrame:
    """Every row is a violation."""
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def missing_keys(df: DataFrame, **domains: DataFrame) -> DataFrame:
    """Keys of the full grid of small domains (years by districts) that the table lacks."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [d.select(k).distinct() for k, d in domains.items()])
    return grid.join(df.select(*domains), list(domains), "left_anti")


def rollup_gap(df: DataFrame, scope: str, fields: list[str], tolerance: float) -> DataFrame:
    """Fields whose groups don't sum to the whole."""
    sums = df.groupBy(scope).agg(*[F.sum(f).alias(f) for f in fields])
    wide = sums.agg(*[F.abs(F.max(F.when(F.col(scope) == "city", F.col(f))) - F.max(F.when(F.col(scope) == "district", F.col(f)))).alias(f) for f in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("gap")) for f in fields])).alias("r")).select("r.*").where(F.col("gap") > tolerance)


def conservation_gap(df: DataFrame, parts: list[str], whole: str, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose parts do not add up to the whole, or are negative, or exceed it."""
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    wrong = reduce(lambda a, b: a | b, [(F.col(p) < 0) | (F.col(p) > F.col(whole) + tolerance) for p in parts])
    return df.where(F.coalesce((F.abs(total - F.col(whole)) > tolerance) | wrong, F.lit(True)))


def ratio_gap(df: DataFrame, share: str, part: str, whole: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose share (percent) is not part over whole; a share must be 0 or null where the whole is 0."""
    want = F.try_divide(100.0 * F.col(part), F.col(whole))
    return df.where(F.when(F.col(whole) == 0, F.coalesce(F.col(share), F.lit(0.0)) != 0).otherwise(F.coalesce(F.abs(F.col(share) - want) > tolerance, F.lit(True))))


def zero_share_gap(df: DataFrame, share: str, nearest: str, budget: float) -> DataFrame:
    """Rows where a zero share and a nearest distance beyond the budget do not go together."""
    return df.where(F.coalesce((F.col(share) == 0) != (F.col(nearest) > budget), F.lit(True)))


def event_gap(events: DataFrame, series: DataFrame, state: str = "state_id", year: str = "year") -> DataFrame:
    """Years that are an event but no change of state, a change but no event, or an event with another state than the series."""
    w = Window.orderBy(year)
    changes = series.withColumn("_was", F.lag(state).over(w)).where(F.col("_was") != F.col(state)).select(year, F.col(state).alias("_s"))
    j = events.select(year, F.col(state).alias("_e")).join(changes, year, "full")
    return j.where(~F.col("_e").eqNullSafe(F.col("_s")))


def counterfactual_gap(df: DataFrame, observed: str, fixed: str, state: str, base: int, year: str = "year", tolerance: float = 1e-9) -> DataFrame:
    """Violations of a counterfactual: it equals what is observed in the base year, and is constant within a state."""
    at_base = df.where((F.col(year) == base) & F.coalesce(F.abs(F.col(observed) - F.col(fixed)) > tolerance, F.lit(True))).select(F.lit("base year").alias("rule"), F.col(year).cast("string").alias("at"))
    moves = df.groupBy(state).agg(F.min(fixed).alias("lo"), F.max(fixed).alias("hi")).where(F.col("hi") - F.col("lo") > tolerance)
    return at_base.unionByName(moves.select(F.lit("constant state").alias("rule"), F.col(state).cast("string").alias("at")))


def unlike_within(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups in which a column that must be one value has several."""
    counts = df.groupBy(*keys).agg(*[F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("\x00")))).alias(c) for c in columns])
    return counts.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def implausible(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, rows) with values that are null, NaN or out of range; no row where all is well."""
    bad = {c: F.coalesce(~F.col(c).between(lo, hi) | F.isnan(F.col(c).cast("double")), F.lit(True)) for c, (lo, hi) in ranges.items()}
    one = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in ranges])).alias("r")).select("r.*").where("rows > 0")


def invalid_positions(df: DataFrame, connector: str = "connector_m", total: str = "distance", fraction: str = "fraction") -> DataFrame:
    """Rows whose connector exceeds the total, whose fraction is out of 0 to 1, or that are negative or not finite (an unreached total may be infinite)."""
    c, t, f = F.col(connector), F.col(total), F.col(fraction)
    return df.where(F.coalesce((c > t) | (f < 0) | (f > 1) | (c < 0) | F.isnan(c) | F.isnan(t) | F.isnan(f) | (c == float("inf")), F.lit(True)))


def copied(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column) where the copy b has another value than a, as text, or lacks the row: exact copies differ nowhere.

    A column of another type is another value, also where its text is equal.
    """
    values = [c for c in a.columns if c not in keys]
    kinds = {c: (dict(a.dtypes)[c], dict(b.dtypes).get(c)) for c in values}
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in values])
    right = b.select(*keys, F.lit(True).alias("_b"), *[(F.col(c) if kinds[c][1] else F.lit(None)).cast("string").alias(f"b_{c}") for c in values])
    j = left.join(right, keys, "full")
    differ = lambda c: F.lit(kinds[c][0] != kinds[c][1]) | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) | F.col("_a").isNull() | F.col("_b").isNull()
    return j.select(*keys, F.explode(F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in values]))).alias("column"))


def untiled(points: DataFrame, held: DataFrame, whole: float, areas: DataFrame, inside: float = 0.99, slack: float = 0.01) -> DataFrame:
    """(rule, value) of the tiling rules that polygons break: the share of points that exactly one holds, and the sum of their areas over the whole.

    ``points``: point_id; ``held``: point_id, method as of ``spatial.assign_polygon``; ``areas``: name, area.
    """
    share = points.select("point_id").join(held.select("point_id", "method"), "point_id", "left").agg(F.avg((F.col("method") == "within").cast("double")).alias("value")).select(F.lit("inside").alias("rule"), "value").where(f"value < {inside}")
    cover = areas.agg((F.sum("area") / whole).alias("value")).select(F.lit("cover").alias("rule"), "value").where(f"abs(value - 1) > {slack}")
    return share.unionByName(cover)


def demand(checks: DataFrame) -> DataFrame:
    """Raises if any check has violations; returns the table."""
    bad = checks.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))
    return checks
