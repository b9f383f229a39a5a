"""Joins with guards: validated and complete joins, fallbacks, overlaps of name sets, radius anti joins, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.operators import spatial


def validated(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "1:1") -> DataFrame:
    """An equi join that raises where a side that must be unique repeats a key (``1:1``, ``m:1`` or ``1:m``)."""
    for side, name, must in ((left, "left", validate[0] == "1"), (right, "right", validate[2] == "1")):
        if must:
            again = side.groupBy(*keys).count().where("count > 1").limit(5).collect()
            if again:
                raise ValueError(f"{name} side repeats keys {[tuple(r)[:-1] for r in again]}")
    return left.join(right, keys, how)


def complete(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A left join 1:1 that raises where any of ``values`` is missing."""
    out = validated(left, right, keys, "left")
    lost = out.where(reduce(lambda a, b: a | b, [F.col(v).isNull() for v in values])).select(*keys).limit(5).collect()
    if lost:
        raise ValueError(f"no metric for {[tuple(r) for r in lost]}")
    return out


def mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side that lacks them (null-safe)."""
    on = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, on(a, b), "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, on(b, a), "left_anti").withColumn("missing_in", F.lit("left")))


def keyed_both_ways(left: DataFrame, right: DataFrame, key: Column, on: Column, name: str = "match_key") -> DataFrame:
    """Join 1:1 on a normalised key (``key`` of the left, ``on`` of the right) that raises on keys of one side only."""
    a, b = left.withColumn(name, key), right.withColumn(name, on)
    lost = mismatches(a, b, [name]).limit(5).collect()
    if lost:
        raise ValueError(f"keys of one side only: {[tuple(r) for r in lost]}")
    return validated(a, b, [name])


def crosswalk(codes: dict[str, str], c: Column) -> Column:
    """The code of an id by an explicit map; an id that it lacks raises, it is never guessed."""
    known = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])
    return F.coalesce(F.element_at(known, c.cast("string")), F.raise_error(F.concat(F.lit("no code for "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string"))


def with_nearest_polygon(points: DataFrame, sides: DataFrame, size: float = 250.0) -> DataFrame:
    """(point_id, district, method): the first polygon that holds the point, else the nearest by its sides, ties to the first name.

    Every point gets a district, unlike ``spatial.assign_polygon``, which leaves those outside unassigned.
    """
    inside = spatial.assign_polygon(points, sides, tolerance=0.0)
    held = inside.where("district IS NOT NULL").select("point_id", "district", F.lit("within").alias("method"))
    out = points.join(held.select("point_id"), "point_id", "left_anti")
    numbered = sides.select(F.xxhash64("name", "x1", "y1", "x2", "y2").alias("edge_id"), F.lit(1.0).alias("cost_m"), "x1", "y1", "x2", "y2", "name")
    # ties between polygons go to the first name: it is the id that the search breaks ties by
    near = spatial.snap_to_edges(out, numbered.withColumn("edge_id", F.col("name")).drop("name"), size)
    return held.unionByName(near.select("point_id", F.col("edge_id").alias("district"), F.lit("nearest").alias("method")))


def nearest_within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Left join to the nearest target no farther than ``radius``: point_id, target_id and distance, null beyond."""
    near = spatial.nearest_points(points, targets, max(radius, 1e-6))
    on = near.where(F.col("distance") <= radius)
    return points.select("point_id").join(on, "point_id", "left")


def sharing(left: DataFrame, right: DataFrame, keys: str = "keys") -> DataFrame:
    """(left_id, right_id) of rows (id, ``keys``: array) whose arrays share an element that is neither null nor empty."""
    one = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(keys)).alias("k")).where("k IS NOT NULL AND k <> ''")
    return one(left, "left_id").join(one(right, "right_id"), "k").select("left_id", "right_id").distinct()


def without_near(rows: DataFrame, others: DataFrame, named: float, unnamed: float, keys: str = "keys") -> DataFrame:
    """Rows (id, x, y, ``keys``: array of names) with no other row near: within ``named`` metres if they share a name, within ``unnamed`` whatever its names if the row has none.

    Null and empty names are none. Named rows meet others by name and grid cell, the rest by cell: equi joins in which only the
    nearest cells meet. Rows without coordinates have nothing near.
    """
    names = lambda df: df.withColumn("k", F.filter(F.array_distinct(F.coalesce(F.col(keys).cast("array<string>"), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    a = names(rows).select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), "k")
    b = names(others).select(F.col("x").alias("bx"), F.col("y").alias("by"), "k")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)

    def hits(left: DataFrame, right: DataFrame, radius: float, on: list[str]) -> DataFrame:
        size = max(radius, 1e-6)
        for g, c in (("gx", "ax"), ("gy", "ay")):
            left = left.withColumn(g, F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1)))
        right = right.withColumn("gx", F.floor(F.col("bx") / size)).withColumn("gy", F.floor(F.col("by") / size))
        return left.join(right, [*on, "gx", "gy"]).where(d <= radius).select("id")

    one = lambda df: df.withColumn("k", F.explode("k"))
    gone = hits(one(a), one(b), named, ["k"]).union(hits(a.where(F.size("k") == 0), b.drop("k"), unnamed, [])).distinct()
    return rows.join(gone, "id", "left_anti")


def reconciled(frozen: DataFrame, fresh: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Every key of either side with, for each value, the difference and whether it is within the tolerance.

    A key or value on one side only is not within. Columns: keys, side (both, frozen, fresh), and v_diff, v_ok for each v.
    """
    a = frozen.select(*keys, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = fresh.select(*keys, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    j = a.join(b, keys, "full")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "frozen").otherwise("fresh")
    out = [side.alias("side")]
    for v in values:
        diff = F.col(f"b_{v}") - F.col(f"a_{v}")
        out += [diff.alias(f"{v}_diff"), F.coalesce((F.abs(diff) <= tolerance) | (F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull() & (side == "both")), F.lit(False)).alias(f"{v}_ok")]
    return j.select(*keys, *out)
