"""Polygons of any shape: lengths and sums inside them, tiling checks, clipped grids. Native expressions, even-odd rule.

Polygons come as sides (name, x1, y1, x2, y2; see ``spatial.ring_edges``); rings of holes are sides like others.
Points meet sides in row bands, edges meet them in grid cells, cells of a raster by row and column: equi joins all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators import overlay, spatial


def areas(sides: DataFrame) -> DataFrame:
    """(name, area): shoelace over the sides; holes must turn the other way."""
    return sides.groupBy("name").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))


def boxes(sides: DataFrame) -> DataFrame:
    """Bounding box of each polygon: name, bx1, by1, bx2, by2."""
    return sides.groupBy("name").agg(F.min(F.least("x1", "x2")).alias("bx1"), F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("x1", "x2")).alias("bx2"), F.max(F.greatest("y1", "y2")).alias("by2"))


def bounding_box(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def window_of(box: DataFrame, x0: float, y0: float, size: float, rows: int, cols: int) -> DataFrame:
    """The smallest window of a raster's whole cells that covers a box: row, col, height, width. Row 0 lies at y0, the top."""
    col = F.greatest(F.floor((F.col("x1") - x0) / size), F.lit(0))
    row = F.greatest(F.floor((y0 - F.col("y2")) / size), F.lit(0))
    end_c = F.least(F.ceil((F.col("x2") - x0) / size), F.lit(cols))
    end_r = F.least(F.ceil((y0 - F.col("y1")) / size), F.lit(rows))
    return box.select(row.alias("row"), col.alias("col"), F.greatest(end_r - row, F.lit(0)).alias("height"), F.greatest(end_c - col, F.lit(0)).alias("width"))


def rasterized(sides: DataFrame, x0: float, y0: float, size: float, rows: int, cols: int) -> DataFrame:
    """(name, row, col): the cells whose centre each polygon holds, by scanline. Row 0 lies at y0, the top.

    Each side goes to the rows whose middle it crosses; a row's crossings are sorted and paired to stretches of columns, and these
    become cells. No cell is tested against a polygon. A centre on a side or a vertex counts as held.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    top, low = F.greatest(y1, y2), F.least(y1, y2)
    # rows whose middle y0 - (row + 0.5) * size lies in [low, top)
    first = F.greatest(F.floor((y0 - top) / size - 0.5) + 1, F.lit(0))
    last = F.least(F.floor((y0 - low) / size - 0.5), F.lit(rows - 1))
    crossed = sides.where(y1 != y2).withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    level = F.lit(y0) - (F.col("row") + 0.5) * size
    at = crossed.select("name", "row", (x1 + (level - y1) * (x2 - x1) / (y2 - y1)).alias("x"))
    lines = at.groupBy("name", "row").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") >= 2)
    spans = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))))
    a, b = F.get("xs", F.col("k")), F.get("xs", F.col("k") + 1)
    # sides that end at, or lie along, the middle of a row: the half-open rule above leaves these points out
    ends = sides.withColumn("p", F.explode(F.array(F.struct(y1.alias("y"), x1.alias("a"), F.when(y1 == y2, x2).otherwise(x1).alias("b")), F.struct(y2.alias("y"), x2.alias("a"), x2.alias("b")))))
    at_row = (y0 - F.col("p.y")) / size - 0.5
    on = ends.where((at_row == F.floor(at_row)) & (at_row >= 0) & (at_row < rows)).select("name", F.floor(at_row).alias("row"), F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))
    every = spans.select("name", "row", a.alias("a"), b.alias("b")).unionByName(on)
    lo = F.greatest(F.ceil((F.col("a") - x0) / size - 0.5), F.lit(0))
    hi = F.least(F.floor((F.col("b") - x0) / size - 0.5), F.lit(cols - 1))
    found = every.select("name", "row", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return found.select("name", "row", F.explode(F.sequence("lo", "hi")).alias("col")).distinct()


def zonal(raster: DataFrame, sides: DataFrame, x0: float, y0: float, size: float, rows: int, cols: int) -> DataFrame:
    """Cells (row, col, value) by the polygon that holds their centre (the first name), null values left out: name, cells, total."""
    own = rasterized(sides, x0, y0, size, rows, cols).groupBy("row", "col").agg(F.min("name").alias("name"))
    known = raster.where("value IS NOT NULL AND NOT isnan(value)")
    return known.join(own, ["row", "col"]).groupBy("name").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


def inside_parts(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(edge_id, name, f0, f1, length_m): the stretches of straight edges that lie inside each polygon.

    An edge is cut where it crosses a side, which it meets in the grid cells that both pass; the middle of each piece says whether the
    piece is inside, and of an edge that crosses no side of a polygon its own. An edge along a side counts as inside or outside as a whole.
    ``edges``: edge_id, x1, y1, x2, y2.
    """
    size = max(sides.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).alias("m")).first()["m"] or 1.0, 1e-6)
    ends = ("x1", "y1", "x2", "y2")
    mine = overlay.cells_crossed(edges.select("edge_id", *ends), size).select("edge_id", "gx", "gy", *[F.col(c).alias("e" + c) for c in ends])
    theirs = overlay.cells_crossed(sides.select("name", *ends), size).select("name", "gx", "gy", *[F.col(c).alias("s" + c) for c in ends])
    dx, dy = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    sx, sy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    det = dx * sy - dy * sx
    qx, qy = F.col("sx1") - F.col("ex1"), F.col("sy1") - F.col("ey1")
    safe = F.when(det != 0, det)
    t, u = (qx * sy - qy * sx) / safe, (qx * dy - qy * dx) / safe
    crossing = mine.join(theirs, ["gx", "gy"]).where((t > 0) & (t < 1) & (u >= 0) & (u <= 1))
    cuts = crossing.groupBy("edge_id", "name").agg(F.collect_set(t).alias("ts"))
    line = edges.select("edge_id", *ends)
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.col("ts"))))
    pieces = line.join(cuts, "edge_id").withColumn("ends", stops).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)))
    pieces = pieces.select("edge_id", "name", *ends, F.element_at("ends", F.col("i")).alias("f0"), F.element_at("ends", F.col("i") + 1).alias("f1"))
    at = lambda a, b, f: F.col(a) + f * (F.col(b) - F.col(a))
    mid = (F.col("f0") + F.col("f1")) / 2
    probe = lambda df, *k: df.select(F.struct("edge_id", *k).alias("point_id"), *[c for c in ("name",) if c in df.columns], at("x1", "x2", mid).alias("x"), at("y1", "y2", mid).alias("y"))
    cut_in = spatial.held_by(probe(pieces, "f0", "f1"), sides, on=["name"]).where("inside").select("point_id.*", "name")
    every = line.withColumn("f0", F.lit(0.0)).withColumn("f1", F.lit(1.0))
    whole_in = spatial.held_by(probe(every, "f0", "f1"), sides).where("inside").select("point_id.*", "name").join(cuts.select("edge_id", "name"), ["edge_id", "name"], "left_anti")
    held = cut_in.unionByName(whole_in)
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return held.join(line.select("edge_id", length.alias("len")), "edge_id").select("edge_id", "name", "f0", "f1", ((F.col("f1") - F.col("f0")) * F.col("len")).alias("length_m"))


def lengths(parts: DataFrame) -> DataFrame:
    """Length inside each polygon, each by itself: name, length_km."""
    return parts.groupBy("name").agg((F.sum("length_m") / 1000).alias("length_km"))


def shared_once(parts: DataFrame) -> DataFrame:
    """Length by polygon with stretches in several counted for the first name only: (name, length_km, shared_km).

    The sum over names is the length inside the union of the polygons.
    """
    rate = F.max(F.col("length_m") / (F.col("f1") - F.col("f0")))
    cuts = parts.groupBy("edge_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("f0", "f1"))))).alias("cuts"), rate.alias("len"))
    pieces = cuts.select("edge_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("lo"), F.element_at("cuts", i + 1).alias("hi")))).alias("p"))
    own = pieces.join(parts, "edge_id").where((F.col("f0") <= F.col("p.lo")) & (F.col("f1") >= F.col("p.hi")))
    per = own.groupBy("edge_id", "p", "len").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    metres = (F.col("p.hi") - F.col("p.lo")) * F.col("len")
    return per.groupBy("name").agg((F.sum(metres) / 1000).alias("length_km"), (F.sum(F.when(F.col("n") > 1, metres).otherwise(0.0)) / 1000).alias("shared_km"))


def clipped_grid(points: DataFrame, box: tuple[float, float, float, float], size: float = 500.0) -> DataFrame:
    """``surface.density_grid`` clipped to a box: squares outside go, density is over the part of the square inside.

    Columns: row, col, weight, area_km2, density_km2 and retained_pct, the share of all weight that the kept squares hold.
    """
    x1, y1, x2, y2 = box
    bins = points.groupBy(F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).agg(F.sum("weight").alias("weight")).where("weight > 0")
    w = F.least(F.lit(x2), (F.col("col") + 1) * size) - F.greatest(F.lit(x1), F.col("col") * size)
    h = F.least(F.lit(y2), (F.col("row") + 1) * size) - F.greatest(F.lit(y1), F.col("row") * size)
    kept = bins.withColumn("area_km2", F.when((w > 0) & (h > 0), w * h / 1e6)).where("area_km2 > 0")
    every = points.agg(F.sum("weight").alias("all_weight"))
    held = kept.agg(F.sum("weight").alias("kept_weight"))
    facts = every.crossJoin(held)  # one row each
    share = F.round(F.try_divide(100.0 * F.col("kept_weight"), F.col("all_weight")), 6).alias("retained_pct")
    return kept.crossJoin(F.broadcast(facts.select(share))).withColumn("density_km2", F.round(F.col("weight") / F.col("area_km2"), 6))


def grid_clipped_by(points: DataFrame, boundary: DataFrame, size: float = 500.0) -> DataFrame:
    """``surface.density_grid`` clipped to a boundary of any shape (sides x1, y1, x2, y2): row, col, weight, area_km2, density_km2.

    Squares with weight are laid over the boundary (see ``overlay``); those outside go, density is over the part of the square inside.
    """
    bins = points.groupBy(F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).agg(F.sum("weight").alias("weight")).where("weight > 0")
    corner = lambda i, j: F.struct(((F.col("col") + i) * size).cast("double").alias("x"), ((F.col("row") + j) * size).cast("double").alias("y"))
    # names: the boundary sorts before the squares, which pairs it with each of them
    square = bins.select(F.concat_ws(":", F.lit("square"), "row", "col").alias("name"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    sides = spatial.ring_edges(square).unionByName(boundary.select(F.lit("boundary").alias("name"), "x1", "y1", "x2", "y2"))
    inside = overlay.overlaps(overlay.faces(overlay.with_layer(sides))).where("a = 'boundary' AND area > 1e-6")
    parts = F.split("b", ":")
    held = inside.select(parts[1].cast("long").alias("row"), parts[2].cast("long").alias("col"), (F.col("area") / 1e6).alias("area_km2"))
    return bins.join(held, ["row", "col"]).withColumn("density_km2", F.col("weight") / F.col("area_km2"))
