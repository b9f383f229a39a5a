"""Map elements (nodes, ways, relations with tags) to classified rows with one geometry and one point."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.functions import text
from netaccess.operators import overlay, spatial
from netaccess.operators.lineage import cut

POINT = "struct<x:double,y:double>"
LINE = "array<struct<lat:double,lon:double>>"
ELEMENT = f"struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,geometry:{LINE},tags:map<string,string>,members:array<struct<role:string,geometry:{LINE}>>>"


def tag(key: str, tags: str = "tags") -> Column:
    """The value of a tag, null where the element or the column lacks it."""
    return F.try_element_at(F.col(tags), F.lit(key))


def line_length(points: Column) -> Column:
    """Length of a line of points (x, y)."""
    legs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.sqrt((F.get(points, i)["x"] - F.get(points, i - 1)["x"]) ** 2 + (F.get(points, i)["y"] - F.get(points, i - 1)["y"]) ** 2))
    return F.when(F.size(points) > 1, F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def ring_area(points: Column) -> Column:
    """Area of a closed ring by the shoelace formula, whichever way it turns."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(points, i - 1)["x"] * F.get(points, F.when(i < n, i).otherwise(F.lit(0)))["y"] - F.get(points, F.when(i < n, i).otherwise(F.lit(0)))["x"] * F.get(points, i - 1)["y"])
    return F.when(n > 2, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(F.lit(0.0))


def line_midpoint(points: Column) -> Column:
    """The point half way along a line, by length."""
    half = line_length(points) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.get(points, F.lit(0))["x"].alias("x"), F.get(points, F.lit(0))["y"].alias("y"), F.lit(False).alias("hit"))

    def walk(at: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        leg = F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)
        t = F.when(leg > 0, (half - at["done"]) / leg).otherwise(F.lit(0.0))
        here = ~at["hit"] & (at["done"] + leg >= half)
        return F.struct((at["done"] + leg).alias("done"), F.when(here, a["x"] + t * (b["x"] - a["x"])).otherwise(at["x"]).alias("x"), F.when(here, a["y"] + t * (b["y"] - a["y"])).otherwise(at["y"]).alias("y"), (at["hit"] | here).alias("hit"))

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), start, walk)
    return F.when(F.size(points) > 1, F.struct(end["x"].alias("x"), end["y"].alias("y"))).otherwise(F.get(points, F.lit(0)).cast(POINT))


def interior_point(points: Column) -> Column:
    """A point inside a ring: the middle of the widest stretch inside it, half way up its bounding box; null if it has no inside there."""
    ys = F.transform(points, lambda p: p["y"])
    level = (F.array_min(ys) + F.array_max(ys)) / 2
    n = F.size(points)

    def crossing(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, F.when(i < n, i).otherwise(F.lit(0)))
        return F.when((a["y"] > level) != (b["y"] > level), a["x"] + (level - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))

    xs = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crossing)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(xs) / 2).cast("int"), F.lit(1))), lambda k: F.struct((F.get(xs, 2 * k - 1) - F.get(xs, 2 * k - 2)).alias("w"), ((F.get(xs, 2 * k - 1) + F.get(xs, 2 * k - 2)) / 2).alias("x")))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(pairs)["x"].alias("x"), level.alias("y")))


def parsed(raw: DataFrame, column: str) -> DataFrame:
    """JSON text to elements, one for each (type, id): of differing ones the first by its JSON text."""
    e = raw.select(F.from_json(column, ELEMENT).alias("e"), F.col(column).alias("j")).where("e.type IS NOT NULL AND e.id IS NOT NULL")
    return e.groupBy("e.type", "e.id").agg(F.min_by("e", "j").alias("e")).select("e.*")


def elements(raw: DataFrame, column: str) -> DataFrame:
    """JSON text of one element a row to rows (type, id, tags, kind, method, rank, points, x, y), one for each (type, id).

    kind is point, line or polygon and method how it came about: node, closed_way (a ring of at least four points whose first is
    the last), open_way, relation_center, way_center. Elements without any place go. x and y are the point that stands for the
    element: the node, the middle of a line by length, a point inside a polygon; rank is 0 for polygons, 1 for lines, 2 for points.
    """
    e = parsed(raw, column).drop("members")
    shape = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    n = F.coalesce(F.size(F.col("geometry")), F.lit(0))
    n = F.when(F.col("geometry").isNull(), F.lit(0)).otherwise(n)
    closed = (n >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    method = (
        F.when((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), "node")
        .when((F.col("type") == "way") & closed, "closed_way").when((F.col("type") == "way") & (n >= 2), "open_way")
        .when(F.col("center.lat").isNotNull() & F.col("center.lon").isNotNull(), F.concat("type", F.lit("_center")))
    )
    e = e.withColumn("method", method).where("method IS NOT NULL").withColumn("points", F.when(F.col("method").isin("closed_way", "open_way"), shape))
    kind = F.when(F.col("method") == "closed_way", "polygon").when(F.col("method") == "open_way", "line").otherwise("point")
    ring = F.slice("points", 1, F.size("points") - 1)
    single = F.struct(F.coalesce("lon", "center.lon").alias("x"), F.coalesce("lat", "center.lat").alias("y"))
    at = F.when(F.col("method") == "closed_way", F.coalesce(interior_point(ring), line_midpoint(F.col("points")))).when(F.col("method") == "open_way", line_midpoint(F.col("points"))).otherwise(single)
    return e.select("type", "id", "tags", kind.alias("kind"), "method", geometry_rank(kind).alias("rank"), "points", at.alias("at")).select("*", F.col("at.x").alias("x"), F.col("at.y").alias("y")).drop("at")


def geometry_rank(kind: Column) -> Column:
    """0 polygon, 1 line, 2 point: which of two duplicates is kept."""
    return F.when(kind == "polygon", 0).when(kind == "line", 1).otherwise(2)


def is_(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_metro_station() -> Column:
    """station=subway or subway=yes and no entrance; railway=station alone is none."""
    return (is_(tag("station") == "subway") | is_(tag("subway") == "yes")) & ~is_metro_entrance()


def is_metro_entrance() -> Column:
    return is_(tag("railway") == "subway_entrance")


def is_bus_stop() -> Column:
    """highway=bus_stop, or a platform or stop position with bus=yes that no rail tag belongs to."""
    stop = is_(tag("highway") == "bus_stop")
    rail = tag("railway").isNotNull() | is_(tag("train") == "yes") | is_(tag("subway") == "yes") | is_(tag("tram") == "yes")
    return stop | (is_(tag("public_transport").isin("platform", "stop_position")) & is_(tag("bus") == "yes") & ~rail)


def stop_role() -> Column:
    return F.when(is_(tag("highway") == "bus_stop") | is_(tag("public_transport") == "platform"), "platform").otherwise("stop_position")


def keep_priority(element: Column, name: Column) -> Column:
    """0 to 3: nodes before the rest, latin names before others."""
    return F.when(element == "node", 0).otherwise(2) + F.when(text.is_latin(name), 0).otherwise(1)


def classified(raw: DataFrame, column: str, keys: list[str], precedence: list[str]) -> DataFrame:
    """``elements`` with name and category: the first of ``precedence`` that a tag among ``keys`` has; others go."""
    e = elements(raw, column)
    return e.select("*", text.normalised_name(tag("name")).alias("name"), text.category([tag(k) for k in keys], precedence).alias("category")).where("category IS NOT NULL")


def tallies(rows: DataFrame, by: str = "category") -> DataFrame:
    """Rows, named and unnamed ones, and relations and polygons among them, by category."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count("name").alias("named"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.count_if(F.col("type") == "relation").alias("relations"), F.count_if(F.col("kind") == "polygon").alias("polygons")
    )


#: Mean radius of the earth in metres.
EARTH = 6_371_008.8


def projected(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of a reference point (equirectangular, good over a city); degrees out of range raise."""
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    bad = F.raise_error(F.lit("coordinates are not degrees")).cast("double")
    x = F.radians(lon - F.lit(lon0)) * F.cos(F.radians(F.lit(lat0))) * F.lit(EARTH)
    y = F.radians(lat - F.lit(lat0)) * F.lit(EARTH)
    return F.when(ok, x).otherwise(bad), F.when(ok, y).otherwise(bad)


def joined_rings(ways: DataFrame) -> DataFrame:
    """Ways (relation, role, way_id, points) stitched to rings: (relation, role, number, ring) for each closed one.

    A ring is made of ways that meet end to end, in any direction, each used once; what does not close is
    left out. One relation is stitched in one task; relations are small by nature.
    """
    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [[(p["x"], p["y"]) for p in w] for w in pdf.sort_values("way_id")["points"] if w is not None and len(w) > 1]
        out = []
        while left:
            chain = left.pop(0)
            while chain[0] != chain[-1]:
                i = next((i for i, w in enumerate(left) if chain[-1] in (w[0], w[-1])), None)
                if i is None:
                    break
                w = left.pop(i)
                chain += w[1:] if w[0] == chain[-1] else w[-2::-1]
            if chain[0] == chain[-1] and len(chain) >= 4:
                out.append([{"x": x, "y": y} for x, y in chain])
        first = pdf.iloc[0]
        return pd.DataFrame([(int(first["relation"]), str(first["role"]), json.dumps(out))], columns=["relation", "role", "rings"])

    found = ways.select("relation", "role", "way_id", "points").groupBy("relation", "role").applyInPandas(stitch, "relation long, role string, rings string")
    return found.select("relation", "role", F.posexplode(F.from_json("rings", f"array<array<{POINT}>>")).alias("number", "ring"))


def _area_names(names: Column) -> Column:
    """Inside an outer ring and in no inner one."""
    return F.exists(names, lambda n: n.startswith("outer")) & ~F.exists(names, lambda n: n.startswith("inner"))


def relation_outlines(raw: DataFrame, column: str) -> DataFrame:
    """(layer, x1, y1, x2, y2): outlines of relations as areas, one layer for each relation's id, what is inside on the left.

    Member ways of a role are joined end to end to rings. The area is what the rings of all members but the inner ones cover together, less what
    the inner ones cover: overlapping parts are one, holes stay open. Relations whose ways close no ring have no row.
    """
    members = parsed(raw, column).where("type = 'relation'").select(F.col("id").alias("relation"), F.posexplode("members").alias("way_id", "m"))
    points = F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    ways = members.where("m.geometry IS NOT NULL AND size(m.geometry) >= 2")
    role = F.when(F.col("m.role") == "inner", "inner").otherwise("outer")
    rings = joined_rings(ways.select("relation", role.alias("role"), F.col("way_id").cast("long").alias("way_id"), points.alias("points")))
    named = rings.select(F.struct("relation", F.concat("role", F.lit(":"), F.col("number").cast("string")).alias("ring_name")).alias("name"), F.col("ring"))
    sides = spatial.ring_edges(named.withColumn("ring", F.slice("ring", 1, F.size("ring") - 1)))
    return overlay.outline(overlay.faces(sides.select(F.col("name.relation").alias("layer"), F.col("name.ring_name").alias("name"), "x1", "y1", "x2", "y2")), _area_names)


def relation_polygons(raw: DataFrame, column: str) -> DataFrame:
    """(id, area, outers, holes, x, y) of the relations that form an area; x and y lie inside it, never in a hole."""
    outline = cut(relation_outlines(raw, column))
    rings = overlay.linked(outline).groupBy("layer").agg(F.sum("area").alias("area"), F.count_if(F.col("area") > 0).alias("outers"), F.count_if(F.col("area") <= 0).alias("holes"))
    at = overlay.points_inside(outline.withColumn("name", F.lit("area"))).select("layer", "x", "y")
    return rings.join(at, "layer").withColumnRenamed("layer", "id")


def elements_with_areas(raw: DataFrame, column: str) -> DataFrame:
    """``elements`` with relations as areas where their members form one (kind polygon, method relation_area, rank 0); the others keep their centre."""
    areas = relation_polygons(raw, column).select("id", F.lit("relation").alias("type"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    plain = elements(raw, column)
    tags = parsed(raw, column).where("type = 'relation'").select("type", "id", "tags")
    rest = plain.join(areas, ["type", "id"], "left_anti")
    made = tags.join(areas, ["type", "id"]).select(
        "type", "id", "tags", F.lit("polygon").alias("kind"), F.lit("relation_area").alias("method"), F.lit(0).alias("rank"), F.lit(None).cast(f"array<{POINT}>").alias("points"), F.col("ax").alias("x"), F.col("ay").alias("y")
    )
    return rest.unionByName(made)
