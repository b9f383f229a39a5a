"""Places: supply tables, rates, order-dependent deduplication in parallel, layers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators import relate, spatial
from netaccess.operators.lineage import cut


def supply(places: DataFrame, domain: DataFrame, categories: list[str], group: str = "district") -> DataFrame:
    """Counts by group and category over the whole domain of groups, 0 where there is none."""
    counts = places.groupBy(group).agg(*[F.count_if(F.col("category") == c).alias(c.lower().replace(" ", "_")) for c in categories], F.count("*").alias("all"))
    out = domain.select(group).distinct().join(counts, group, "left")
    return out.fillna(0)


def _ordered(places: DataFrame, order: list[str], id_: str):
    """A comparable value for the place in the order: nulls last, the id decides between equals."""
    return F.struct(*[c for o in order for c in (F.col(o).isNull().alias(f"n_{o}"), F.col(o).alias(f"v_{o}"))], F.col(id_).alias("last"))


def _around(cells: DataFrame) -> DataFrame:
    """Rows once for every grid cell within two of their own."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    o = cells.withColumn("o", F.explode(offsets))
    return o.withColumn("gx", F.col("gx") + F.col("o.i")).withColumn("gy", F.col("gy") + F.col("o.j")).drop("o")


def first_kept(entries: DataFrame, radius: float) -> DataFrame:
    """What a walk in order keeps of ``entries`` (id, key, x, y, r), found in parallel: (id, kept_id, distance).

    Two places conflict if they share a key and lie within the radius; a walk by ``r`` keeps a place if none kept before
    conflicts with it. That is the lexicographically first independent set of the conflicts, found in rounds: what
    comes before all its conflicts is kept, what conflicts with it goes, until nothing is left. Places of one key in one grid
    cell (its diagonal is the radius) all conflict, so only the first of each cell can be kept in a round: each
    place meets one row of each cell around it, however many places are close together, and no pairs are made.
    A round's work follows what is left; rounds are at most as many as the longest chain of conflicts in order. kept_id is the first kept
    place in order that conflicts.
    """
    size = max(radius, 1e-6) / math.sqrt(2)
    keys = entries.groupBy("id").agg(F.count("*").alias("nk"))
    all_ = cut(entries.join(keys, "id").select("id", "key", "x", "y", "r", "nk", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")))
    several = bool(all_.where("nk > 1").limit(1).count())
    left, kept = all_, None
    gap = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    while left.limit(1).count():
        first = left.groupBy("key", "gx", "gy").agg(F.min(F.struct("r", "id", "x", "y", "nk")).alias("c"))
        first = first.select("key", "gx", "gy", F.col("c.r").alias("cr"), F.col("c.id").alias("cid"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.nk").alias("nk"))
        if several:  # first of its cell for each of its keys
            whole = first.groupBy("cid").agg(F.count("*").alias("m"), F.first("nk").alias("of")).where("m = of").select("cid")
            first = first.join(whole, "cid")
        first = cut(first.drop("nk"))
        late = _around(first).join(left.select("key", "gx", "gy", "x", "y", "r"), ["key", "gx", "gy"]).where((F.col("r") < F.col("cr")) & (gap <= radius))
        new = cut(first.join(late.select("cid").distinct(), "cid", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        gone = _around(new).join(left.select("id", "key", "gx", "gy", "x", "y"), ["key", "gx", "gy"]).where(gap <= radius).select("id")
        left = cut(left.join(gone.union(new.select("cid")).distinct(), "id", "left_anti"))
    if kept is None:
        return entries.select("id", F.col("id").alias("kept_id"), F.lit(0.0).alias("distance"))
    stays = kept.select("cid").distinct()
    dropped = all_.join(stays, all_.id == stays.cid, "left_anti").select("id", "key", "gx", "gy", "x", "y")
    near = _around(kept).join(dropped, ["key", "gx", "gy"]).where(gap <= radius)
    by = near.groupBy("id").agg(F.min(F.struct("cr", "cid", gap.alias("d"))).alias("m")).select("id", F.col("m.cid").alias("kept_id"), F.col("m.d").alias("distance"))
    return by.unionByName(stays.select(F.col("cid").alias("id"), F.col("cid").alias("kept_id"), F.lit(0.0).alias("distance")))


def _deduped(places: DataFrame, entries: DataFrame, radius: float, id_: str) -> DataFrame:
    """``first_kept`` of the entries (an array of keys each, with r); places without a key or finite coordinates stay."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = entries.where(finite("x") & finite("y")).select(F.col(id_).alias("id"), F.explode("ks").alias("key"), "x", "y", "r")
    found = first_kept(rows, radius)
    own = places.select(F.col(id_).alias("id")).join(found, "id", "left")
    return own.select(F.col("id").alias(id_), F.coalesce("kept_id", "id").alias("kept_id"), F.coalesce("distance", F.lit(0.0)).alias("distance"))


def greedy_dedupe(places: DataFrame, block: list[str], radius: float, order: list[str], id_: str = "place_id") -> DataFrame:
    """Every place with kept_id and distance: of equal blocks, a place goes if one kept before it, by ``order``, is within the radius.

    Without ``block`` any two places may be one. Places with a null or empty block value or without finite
    coordinates never merge. kept_id is the place's own id where it stays; ids are unique. Found in parallel, see ``first_kept``.
    """
    ok = [F.col(b).isNotNull() & (F.col(b).cast("string") != "") for b in block]
    key = F.struct(F.lit(0).alias("all"), *[F.col(b).alias(f"b{i}") for i, b in enumerate(block)])
    some = reduce(lambda a, b: a & b, ok, F.lit(True))
    return _deduped(places, places.where(some).select(id_, F.array(key).alias("ks"), "x", "y", _ordered(places, order, id_).alias("r")), radius, id_)


def dedupe_by_names(places: DataFrame, radius: float, order: list[str], keys: str = "keys", id_: str = "place_id", by: list[str] | None = None) -> DataFrame:
    """``greedy_dedupe`` where a place goes only if one kept before it within the radius shares a name variant with it, and the values of ``by`` (such as a role).

    ``keys`` are the name variants of a place; null and empty ones are none, and a place without any stays.
    """
    names = F.filter(F.array_distinct(F.coalesce(F.col(keys).cast("array<string>"), F.array().cast("array<string>"))), lambda k: k.isNotNull() & (k != ""))
    ks = F.transform(names, lambda k: F.struct(k.alias("k"), *[F.col(b).alias(f"b{i}") for i, b in enumerate(by or [])]))
    return _deduped(places, places.select(id_, ks.alias("ks"), "x", "y", _ordered(places, order, id_).alias("r")), radius, id_)


def kept_places(places: DataFrame, found: DataFrame, id_: str = "place_id") -> DataFrame:
    """The places that a deduplication keeps."""
    return places.join(found.where(F.col("kept_id") == F.col(id_)).select(id_), id_, "left_semi")


#: Radii in metres within which two map objects are one.
STATION_RADIUS, ENTRANCE_RADIUS, PAIR_RADIUS, PAIR_RADIUS_UNNAMED, STOP_RADIUS, BAZAAR_RADIUS = 200.0, 5.0, 50.0, 25.0, 5.0, 100.0


def clipped(places: DataFrame, boundary: DataFrame) -> DataFrame:
    """The places inside the boundary's sides."""
    places = cut(places)  # every step reads it again
    points = places.select(F.col("place_id").alias("point_id"), "x", "y")
    inside = spatial.assign_polygon(points, boundary, 0.0).where("district IS NOT NULL").select(F.col("point_id").alias("place_id"))
    return places.join(inside, "place_id", "left_semi")


def with_district(places: DataFrame, sides: DataFrame) -> DataFrame:
    """Adds district and method: within or, outside of all, nearest."""
    at = relate.with_nearest_polygon(places.select(F.col("place_id").alias("point_id"), "x", "y"), sides)
    return places.join(at.withColumnRenamed("point_id", "place_id"), "place_id")


def metro_layer(places: DataFrame, sides: DataFrame, boundary: DataFrame, radius: float = STATION_RADIUS) -> DataFrame:
    """Stations and entrances inside the boundary with a district, without duplicates.

    ``places``: place_id, x, y, keys, kind (station or entrance), priority. Stations that share a name within the radius are one, the lowest
    priority stays; entrances are one within ``ENTRANCE_RADIUS`` whatever they are called.
    """
    inside = cut(clipped(places, boundary))
    stations, entrances = inside.where("kind = 'station'"), inside.where("kind = 'entrance'")
    kept = kept_places(stations, dedupe_by_names(stations, radius, ["priority", "place_id"]))
    kept = kept.unionByName(kept_places(entrances, greedy_dedupe(entrances, [], ENTRANCE_RADIUS, ["place_id"])))
    return with_district(cut(kept), sides)


def bus_layer(places: DataFrame, sides: DataFrame, boundary: DataFrame) -> DataFrame:
    """Bus stops inside the boundary with a district.

    ``places``: place_id, x, y, keys, role (platform or stop_position). Rule A: a stop position with a platform of a shared name
    within ``PAIR_RADIUS``, or without a name and any platform within ``PAIR_RADIUS_UNNAMED``, is that platform. Rule B: stops of one role that share a name
    within ``STOP_RADIUS`` are one; stops on two sides of a street stay apart.
    """
    inside = cut(clipped(places, boundary))
    platforms = inside.where("role = 'platform'")
    alone = relate.without_near(inside.where("role <> 'platform'").withColumnRenamed("place_id", "id"), platforms, PAIR_RADIUS, PAIR_RADIUS_UNNAMED)
    paired = cut(platforms.unionByName(alone.withColumnRenamed("id", "place_id")))
    return with_district(cut(kept_places(paired, dedupe_by_names(paired, STOP_RADIUS, ["place_id"], by=["role"]))), sides)


def layer(places: DataFrame, sides: DataFrame, boundary: DataFrame, radius: float, order: list[str], keys: str = "keys") -> DataFrame:
    """A layer as the analyses use it: clipped to the boundary, without duplicates of a shared name within the radius, each place with a district.

    ``places``: place_id, x, y, ``keys`` and what ``order`` names. Adds district and method (within or nearest).
    """
    kept = cut(clipped(places, boundary))
    return with_district(kept_places(kept, dedupe_by_names(kept, radius, order, keys)), sides)


def built_class(places: DataFrame, sides: DataFrame, radius: float) -> DataFrame:
    """A facility class: duplicates of one category and name go, polygons before lines before points; districts are never guessed.

    ``places``: place_id, x, y, category, name, rank. Adds district (null outside) and method.
    """
    places = cut(places)  # every step reads it again
    kept = kept_places(places, greedy_dedupe(places, ["category", "name"], radius, ["rank", "place_id"]))
    at = spatial.assign_polygon(kept.select(F.col("place_id").alias("point_id"), "x", "y"), sides)
    return kept.join(at.withColumnRenamed("point_id", "place_id"), "place_id", "left")


def scope_counts(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Places by how they were assigned: within, on a boundary, outside."""
    return assigned.groupBy(*by).agg(F.count("*").alias("places"), *[F.count_if(F.col("method") == m).alias(m) for m in ("within", "boundary_tie", "outside")])


def dedupe_summary(pairs: DataFrame, id_: str = "place_id") -> DataFrame:
    gone = F.when(F.col("kept_id") != F.col(id_), F.col("distance"))
    return pairs.agg(F.count_if(F.col("kept_id") == F.col(id_)).alias("kept"), F.count(gone).alias("dropped"), F.round(F.min(gone), 4).alias("min"), F.round(F.percentile(gone, F.lit(0.5)), 4).alias("median"), F.round(F.max(gone), 4).alias("max"))


def consensus(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The one distinct non-null value of each group, else null, with the number of distinct values."""
    return rows.groupBy(by).agg(F.count_distinct(value).alias("values"), F.when(F.count_distinct(value) == 1, F.min(value)).alias("agreed"))
