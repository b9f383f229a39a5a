"""Overlay of polygons of any shape: union, difference, overlaps, rings with holes, points inside.

Polygons come as sides (layer, name, x1, y1, x2, y2), filled by the even-odd rule; polygons meet within their layer alone, so
many overlays (one for each map relation, say) run as one. All sides are cut where they meet others (grid cells find the
pairs, by equality), and what is left are pieces that meet at their ends only. A ray from the middle of each piece counts which
polygons lie on its left and on its right. Every result is a choice of pieces: the area of whatever a condition holds for is
the sum over the pieces where it changes from one side to the other (Green), its outline is these pieces, linked to rings.
Coordinates are on a grid of ``GRID`` metres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators.lineage import cut, written

#: Digits that coordinates are rounded to: sides that meet do so in equal numbers.
GRID = 6
ENDS = ["x1", "y1", "x2", "y2"]


def with_layer(sides: DataFrame, layer: str = "all") -> DataFrame:
    """Sides (name, x1, y1, x2, y2) as one layer."""
    return sides.withColumn("layer", F.lit(layer))


def _upward(rows: DataFrame) -> DataFrame:
    """Sides turned so that they go up, or right where they are level; those without length or finite ends go."""
    r = {c: F.round(F.col(c), GRID) + F.lit(0.0) for c in ENDS}
    swap = (r["y1"] > r["y2"]) | ((r["y1"] == r["y2"]) & (r["x1"] > r["x2"]))
    turned = {a: F.when(swap, r[b]).otherwise(r[a]) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"], strict=True)}
    rows = rows.select("layer", "name", *[turned[c].alias(c) for c in ENDS])
    for c in ENDS:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where("x1 <> x2 OR y1 <> y2")


def _odd(rows: DataFrame) -> DataFrame:
    """Equal sides of one polygon cancel in pairs; (layer, ends, names) of what is left."""
    one = rows.groupBy("layer", "name", *ENDS).agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    return one.groupBy("layer", *ENDS).agg(F.sort_array(F.collect_list("name")).alias("names"))


def _spacing(rows: DataFrame) -> float:
    """Size of grid cells in which a side meets few others: about its mean length."""
    mean = rows.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).alias("m")).first()["m"]
    return max(mean or 1.0, 10.0**-GRID)


def cells_crossed(rows: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Each side (x1, y1, x2, y2) once for every grid cell (gx, gy) that it passes, by columns; no cell of its box that it misses by more than a hair.

    With a margin also for the cells that it comes so near to.
    """
    lo, hi = F.least("x1", "x2") - margin, F.greatest("x1", "x2") + margin
    rows = rows.withColumn("gx", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda x: F.col("y1") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / F.when(dx != 0, dx))) * dy
    a, b = at(F.col("gx") * size - margin), at((F.col("gx") + 1) * size + margin)
    eps = 1e-9 * size + margin
    low = F.when(dx == 0, F.least("y1", "y2")).otherwise(F.least(a, b)) - eps
    high = F.when(dx == 0, F.greatest("y1", "y2")).otherwise(F.greatest(a, b)) + eps
    return rows.withColumn("gy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def pieces(sides: DataFrame) -> DataFrame:
    """(layer, x1, y1, x2, y2, names): the sides cut where they meet; names are the polygons that a piece bounds."""
    whole = cut(_odd(_upward(sides)).withColumn("id", F.xxhash64(*ENDS)))
    size = _spacing(whole)
    tiles = cells_crossed(whole.drop("names"), size)
    keys = ["layer", "gx", "gy"]
    p, q = tiles.select(*keys, "id", *[F.col(c).alias("p" + c) for c in ENDS]), tiles.select(*keys, F.col("id").alias("other"), *[F.col(c).alias("q" + c) for c in ENDS])
    met = p.join(q, keys).where("id < other").select("layer", "id", "other", *["p" + c for c in ENDS], *["q" + c for c in ENDS]).distinct()
    px, py, qx, qy = (F.col(c) for c in ("px1", "py1", "qx1", "qy1"))
    dx, dy, ex, ey = F.col("px2") - px, F.col("py2") - py, F.col("qx2") - qx, F.col("qy2") - qy
    det = dx * ey - dy * ex
    safe = F.when(F.abs(det) > 1e-12, det)
    t, u = ((qx - px) * ey - (qy - py) * ex) / safe, ((qx - px) * dy - (qy - py) * dx) / safe
    tol = 0.5 * 10.0**-GRID

    def on(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        """The point lies on the side a - b."""
        vx, vy = bx - ax, by - ay
        k = ((x - ax) * vx + (y - ay) * vy) / (vx * vx + vy * vy)
        return (k >= 0) & (k <= 1) & (((x - ax - k * vx) ** 2 + (y - ay - k * vy) ** 2) <= tol * tol)

    point = lambda x, y: F.struct(F.round(x, GRID).alias("x"), F.round(y, GRID).alias("y"))
    P, Q = [F.col("p" + c) for c in ENDS], [F.col("q" + c) for c in ENDS]
    ends = [F.when(on(*e, *other), point(*e)) for mine, other in ((P, Q), (Q, P)) for e in (mine[:2], mine[2:])]
    # an end that lies on the other side stands for the crossing
    proper = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & F.coalesce(*ends).isNull(), point(px + t * dx, py + t * dy))
    found = met.withColumn("at", F.array_compact(F.array(proper, *ends))).where(F.size("at") > 0)
    cuts = found.select("layer", "id", F.explode("at").alias("at")).union(found.select("layer", F.col("other").alias("id"), F.explode("at").alias("at")))
    cuts = cuts.groupBy("layer", "id").agg(F.collect_set("at").alias("cuts"))
    rows = whole.join(cuts, ["layer", "id"], "left")
    along = lambda c: (c["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (c["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    every = F.array_distinct(F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))), F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>"))))
    rows = rows.withColumn("ps", F.array_sort(F.transform(every, lambda c: F.struct(along(c).alias("k"), c["x"].alias("x"), c["y"].alias("y")))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ps") - 2)))
    a, b = F.get("ps", F.col("i")), F.get("ps", F.col("i") + 1)
    parts = rows.select("layer", F.explode("names").alias("name"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return _odd(_upward(parts))


def _beyond(some: DataFrame, every: DataFrame, across: bool, size: float) -> DataFrame:
    """(layer, ends, name, crossed): how often a ray from the middle of ``some`` crosses each polygon's pieces, to the right or, ``across``, upwards."""
    x1, y1, x2, y2 = (F.col("o" + c) for c in (["y1", "x1", "y2", "x2"] if across else ENDS))
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    mx, my = (mid_y, mid_x) if across else (mid_x, mid_y)
    at = some.select("layer", *ENDS, mx.alias("mx"), my.alias("my")).withColumn("band", F.floor(F.col("my") / size))
    o = every.select("layer", *[F.col(c).alias("o" + c) for c in ENDS], "names")
    o = o.withColumn("band", F.explode(F.sequence(F.floor(F.least(y1, y2) / size), F.floor(F.greatest(y1, y2) / size))))
    hit = ((y1 > F.col("my")) != (y2 > F.col("my"))) & (x1 + (F.col("my") - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1) > F.col("mx"))
    own = (F.col("ox1") == F.col("x1")) & (F.col("oy1") == F.col("y1")) & (F.col("ox2") == F.col("x2")) & (F.col("oy2") == F.col("y2"))
    crossed = at.join(o, ["layer", "band"]).where(hit & ~own).select("layer", *ENDS, F.explode("names").alias("name"))
    return crossed.groupBy("layer", *ENDS, "name").agg(F.count("*").alias("crossed"))


def faces(sides: DataFrame) -> DataFrame:
    """(layer, x1, y1, x2, y2, left, right): pieces with the names of the polygons on either side."""
    got = cut(pieces(sides))
    size = _spacing(got)
    level = F.col("y1") == F.col("y2")
    steep, flat = got.where(~level), got.where(level)
    crossed = _beyond(steep, steep, False, size).unionByName(_beyond(flat, got.where("x1 <> x2"), True, size))
    own = got.select("layer", *ENDS, F.explode("names").alias("name"), F.lit(1).alias("own"))
    both = crossed.select("layer", *ENDS, "name", "crossed", F.lit(0).alias("own")).unionByName(own.withColumn("crossed", F.lit(0).cast("long")))
    each = both.groupBy("layer", *ENDS, "name").agg(F.sum("crossed").alias("n"), F.max("own").alias("own"))
    # going up, the ray to the right starts on the right of the piece; of a level piece the upward ray starts on its left
    odd, other = F.col("n") % 2 == 1, (F.col("n") + F.col("own")) % 2 == 1
    left, right = F.when(level, odd).otherwise(other), F.when(level, other).otherwise(odd)
    named = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("name"))))
    return each.groupBy("layer", *ENDS).agg(named(left).alias("left"), named(right).alias("right"))


def _green() -> Column:
    return (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2


def _signed(inside) -> Column:
    """A piece's part of the area of what ``inside`` (names to boolean) holds for."""
    return _green() * (inside(F.col("left")).cast("int") - inside(F.col("right")).cast("int"))


def covered(names: Column) -> Column:
    """The union of all polygons."""
    return F.size(names) > 0


def only(a: str, without: str):
    """The difference of two polygons."""
    return lambda names: F.array_contains(names, a) & ~F.array_contains(names, without)


def area_where(faces: DataFrame, inside=covered) -> DataFrame:
    """(layer, area) of what a condition on the covering polygons holds for."""
    return faces.groupBy("layer").agg(F.sum(_signed(inside)).alias("area"))


def areas(faces: DataFrame) -> DataFrame:
    """(layer, name, area) of each polygon, holes left out whichever way they turn."""
    part = lambda c, sign: faces.select("layer", F.explode(c).alias("name"), (_green() * sign).alias("a"))
    return part("left", 1).unionByName(part("right", -1)).groupBy("layer", "name").agg(F.sum("a").alias("area"))


def overlaps(faces: DataFrame) -> DataFrame:
    """(layer, a, b, area) of every two polygons that overlap: the names on a piece's sides are paired, polygons are not."""
    def part(c: str, sign: int) -> DataFrame:
        pairs = F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        return faces.select("layer", F.explode(pairs).alias("p"), (_green() * sign).alias("s"))

    return part("left", 1).unionByName(part("right", -1)).groupBy("layer", "p.a", "p.b").agg(F.sum("s").alias("area"))


def outline(faces: DataFrame, inside=covered) -> DataFrame:
    """(layer, x1, y1, x2, y2) of the pieces where a condition changes, with what it holds for on the left."""
    l, r = inside(F.col("left")), inside(F.col("right"))
    turn = [F.when(l, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"], strict=True)]
    return faces.where(l != r).select("layer", *turn)


#: Polygons of up to so many sides are looked at side by side for being convex.
CONVEX_SIDES = 16


def _convex(sides: DataFrame) -> DataFrame:
    """(layer, name, sides, convex) of polygons with few sides: convex if all corners but a side's own ends lie strictly on one side of it, the same ``left`` or right.

    As many corners as sides, all of them on the hull: that is one ring without a crossing, so it needs no cutting.
    """
    n = F.count("*").over(Window.partitionBy("layer", "name"))
    few = sides.withColumn("n", n).where(F.col("n") <= CONVEX_SIDES).groupBy("layer", "name").agg(F.collect_list(F.struct(*ENDS)).alias("sides"))
    point = lambda q, i: F.struct(q["x" + i].alias("x"), q["y" + i].alias("y"))
    corners = F.array_distinct(F.concat(F.transform("sides", lambda q: point(q, "1")), F.transform("sides", lambda q: point(q, "2"))))
    few = few.withColumn("corners", corners)

    def beyond(q: Column, turn: int) -> Column:
        dx, dy = (q["x2"] - q["x1"]) * turn, (q["y2"] - q["y1"]) * turn
        tol = 4 * 10.0**-GRID * F.sqrt(dx * dx + dy * dy)
        end = lambda c: ((c["x"] == q["x1"]) & (c["y"] == q["y1"])) | ((c["x"] == q["x2"]) & (c["y"] == q["y2"]))
        return F.forall("corners", lambda c: end(c) | (dx * (c["y"] - q["y1"]) - dy * (c["x"] - q["x1"]) > tol))

    seen = F.transform("sides", lambda q: F.struct(*[q[c].alias(c) for c in ENDS], beyond(q, 1).alias("left"), beyond(q, -1).alias("right")))
    fits = (F.size("corners") == F.size("sides")) & (F.size(F.array_distinct("sides")) == F.size("sides")) & (F.size("sides") > 2)
    seen = few.select("layer", "name", seen.alias("sides"), fits.alias("fits"))
    return seen.select("layer", "name", "sides", (F.col("fits") & F.forall("sides", lambda q: q["left"] | q["right"])).alias("convex"))


def oriented(sides: DataFrame) -> DataFrame:
    """(layer, name, x1, y1, x2, y2): each polygon's own outline, its inside on the left of every side. Polygons don't meet each other here.

    Convex polygons are turned as they are; what is left is cut where it meets itself.
    """
    rows = cut(_upward(sides))
    few = cut(_convex(rows))
    turn = [F.when(F.col("q.left"), F.col("q." + a)).otherwise(F.col("q." + b)).alias(a) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"], strict=True)]
    done = few.where("convex").select("layer", "name", F.explode("sides").alias("q")).select("layer", "name", *turn)
    rest = rows.join(few.where("convex").select("layer", "name"), ["layer", "name"], "left_anti").select(F.struct("layer", "name").alias("layer"), F.lit("").alias("name"), *ENDS)
    rest = cut(rest)
    if rest.isEmpty():
        return done
    return done.unionByName(outline(faces(rest)).select("layer.layer", "layer.name", *ENDS))


def outline_areas(outlines: DataFrame) -> DataFrame:
    """(layer, name, area) of each polygon of ``oriented``."""
    return outlines.groupBy("layer", "name").agg(F.sum(_green()).alias("area"))


#: Part of a stretch of a side, and of a grid cell's width and height, at which polygons are counted: far from any simple fraction, where sides tend to meet, and
#: from each other, so that sides at simple angles don't pass there.
ANCHOR, PLACE_X, PLACE_Y = 0.381966011250105, 0.732050807568877, 0.414213562373095


def _leftward(p: str, x: Column, y: Column) -> Column:
    """Above 0 for points on the left of a side, by its length times the distance."""
    return (F.col(p + "x2") - F.col(p + "x1")) * (y - F.col(p + "y1")) - (F.col(p + "y2") - F.col(p + "y1")) * (x - F.col(p + "x1"))


def _square(p: str) -> Column:
    return (F.col(p + "x2") - F.col(p + "x1")) ** 2 + (F.col(p + "y2") - F.col(p + "y1")) ** 2


def _changes(names: list[str], tol: float):
    """What a side (p) that meets another (q) sees change between the places kin and kout, where it passes a grid cell, for batches of pairs: nothing, one change, or two where one lies on the other.

    Changes: the place k along the side and its point; ``inner``, that it only is the cell's border; ``same``, how many sides that precede it lie on it; for each
    number of polygons ``_l``, on the left, ``_w``, the side's own difference of left and right, and ``_b``, what that means for the first piece of its stretch when
    the number at the stretch's anchor, ka, is known. Arrays, as one expression for all this is more than the virtual machine compiles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = {c: rows[c].to_numpy() for c in rows.columns}
            (px1, py1, px2, py2), (qx1, qy1, qx2, qy2) = ([v[p + c] for c in ENDS] for p in "pq")
            dx, dy, ex, ey = px2 - px1, py2 - py1, qx2 - qx1, qy2 - qy1
            pp, qq = dx * dx + dy * dy, ex * ex + ey * ey
            kin, kout, ka = v["kin"], v["kout"], v["ka"]

            def on(ax, ay, bx, by, square, x, y):
                """Place of a point along a side, or nan where it lies off; and by how much it lies on the left."""
                k, off = ((x - ax) * bx + (y - ay) * by) / square, bx * (y - ay) - by * (x - ax)
                return np.where((k >= 0) & (k <= 1) & (off * off <= tol * tol * square), k, np.nan), off

            (k1, c1), (k2, c2) = on(px1, py1, dx, dy, pp, qx1, qy1), on(px1, py1, dx, dy, pp, qx2, qy2)
            (h1, d1), (h2, d2) = on(qx1, qy1, ex, ey, qq, px1, py1), on(qx1, qy1, ex, ey, qq, px2, py2)
            # where they touch: ends of the other on this one, and this one's ends on the other
            k = np.stack([k1, k2, np.where(np.isnan(h1), np.nan, 0.0), np.where(np.isnan(h2), np.nan, 1.0)])
            xs, ys, each = np.stack([qx1, qx2, px1, px2]), np.stack([qy1, qy2, py1, py2]), np.arange(len(rows))
            low, high = np.where(np.isnan(k), np.inf, k).argmin(0), np.where(np.isnan(k), -np.inf, k).argmax(0)
            lo, hi = k[low, each], k[high, each]
            off = np.isnan(lo)
            apart = ~off & ((hi - lo) ** 2 * pp > tol * tol)
            end = ~off & ~apart & (lo > 0) & (lo < 1)
            leaves, comes = end & ~np.isnan(k1) & (c2 > 0), end & np.isnan(k1) & ~np.isnan(k2) & (c1 > 0)
            cross = off & (c1 * c2 < 0) & (d1 * d2 < 0)
            # the same point for both sides, whichever is asked
            first = v["id"] < v["other"]
            ax, bx, ay, by = np.where(first, px1, qx1), np.where(first, dx, ex), np.where(first, py1, qy1), np.where(first, dy, ey)
            cx, fx, cy, fy = np.where(first, qx1, px1), np.where(first, ex, dx), np.where(first, qy1, py1), np.where(first, ey, dy)
            det = bx * fy - by * fx
            t = ((cx - ax) * fy - (cy - ay) * fx) / np.where(det == 0, np.nan, det)
            x, y = np.where(cross, np.round(ax + t * bx, GRID), xs[low, each]), np.where(cross, np.round(ay + t * by, GRID), ys[low, each])
            place = ((x - px1) * dx + (y - py1) * dy) / pp
            # two sides meet in each cell that both pass; the one in which this side holds the point counts
            here = ((kin <= 0) | (place >= kin)) & ((kout >= 1) | (place < kout)) & (leaves | comes | cross)
            turns = np.where(leaves | (cross & (c2 > 0)), -1, np.where(comes | cross, 1, 0))
            aside = ex * (py1 + ka * dy - qy1) - ey * (px1 + ka * dx - qx1)
            early = np.where(cross, np.sign(aside) != np.sign(d1), place < ka)
            same, level = np.where(dx * ex + dy * ey > 0, 1, -1), dy == 0
            # of a stretch in common each cell has its own part
            begin, stop = np.fmax(lo, kin), np.fmin(hi, kout)
            shared = apart & (begin < stop)
            nothing = np.zeros(len(rows), int)
            for chosen, at, point, inner, before, along, moves in (
                (here, place, (x, y), nothing, early, nothing, turns),
                (shared, begin, (xs[low, each], ys[low, each]), (begin > lo) & (begin > 0), begin < ka, nothing + 1, nothing),
                (shared, stop, (xs[high, each], ys[high, each]), (stop < hi) & (stop < 1), stop < ka, nothing - 1, nothing),
            ):
                out = {"pid": v["pid"], "k": np.clip(at, 0.0, 1.0), "x": point[0], "y": point[1], "inner": np.asarray(inner, int), "same": np.where(v["precedes"], along, 0)}
                for c in names:
                    moved, own = v[c] * moves, v[c] * along * same
                    out |= {c + "_l": moved, c + "_w": own, c + "_b": np.where(before, np.where(level, 0, own) - moved, 0)}
                yield pd.DataFrame({n: a[chosen] for n, a in out.items()})

    return run


def _ground(each: DataFrame, w: list[str], size: float, margin: float, deep: int | None) -> DataFrame:
    """(layer, gx, gy, base of each number, covered): the grid cells that sides pass, with how many polygons lie at ``PLACE_X``, ``PLACE_Y`` of the cell.

    Where a row of cells is passed at that height, the sides that cross it change the number; so it is a running sum over the row. Cells that ``deep``
    or more polygons cover whole are left out, as nothing less than ``deep`` is found in there, or ``covered`` if a marked polygon's side passes.
    A polygon covers whole what lies between the cells of a row that its sides pass, if it is inside there.
    """
    ry, rx = (F.col("gy") + PLACE_Y) * size, (F.col("gx") + PLACE_X) * size
    x = F.col("x1") + (ry - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1"))
    here = ((F.col("y1") > ry) != (F.col("y2") > ry)) & (F.floor(x / size) == F.col("gx"))
    number = lambda on, c, alias: F.sum(F.when(on, -F.col(c)).otherwise(0)).alias(alias)
    # dealt by polygons, so all that follows up to the sums of cells stays where it is
    tiles = cells_crossed(each.repartition("layer", "name"), size, margin)
    marks = F.max(F.col("marked") != 0) if "marked" in w else F.max(F.lit(False))
    per = tiles.groupBy("layer", "name", "gy", "gx").agg(*[number(here, c, c + "_all") for c in w], *[number(here & (x < rx), c, c + "_part") for c in w], marks.alias("marks"))
    row = Window.partitionBy("layer", "name", "gy").orderBy("gx")
    per = per.withColumn("inside", F.sum("n_all").over(row)).withColumn("next", F.lead("gx").over(row))
    sums = [c + e for c in w for e in ("_all", "_part")]
    own = F.struct(F.col("gx"), *[F.col(c) for c in sums], F.col("marks"), F.lit(True).alias("passed"), F.lit(0).cast("long").alias("full"))
    edge = lambda at, by: F.struct(at.alias("gx"), *[F.lit(0).cast("long").alias(c) for c in sums], F.lit(False).alias("marks"), F.lit(False).alias("passed"), by.cast("long").alias("full"))
    gap = F.when((F.col("next") > F.col("gx") + 1) & (F.col("inside") > 0), F.array(edge(F.col("gx") + 1, F.lit(1)), edge(F.col("next"), F.lit(-1))))
    found = per.select("layer", "gy", F.inline(F.concat(F.array(own), F.coalesce(gap, F.array().cast(f"array<struct<gx:bigint,{','.join(c + ':bigint' for c in sums)},marks:boolean,passed:boolean,full:bigint>>")))))
    cells = found.groupBy("layer", "gy", "gx").agg(*[F.sum(c).alias(c) for c in sums], F.max("marks").alias("marks"), F.max("passed").alias("passed"), F.sum("full").alias("full"))
    line = Window.partitionBy("layer", "gy").orderBy("gx").rowsBetween(Window.unboundedPreceding, 0)
    base = [(F.sum(c + "_all").over(line) - F.col(c + "_all") + F.col(c + "_part")).alias(c + "_base") for c in w]
    cells = cells.select("layer", "gx", "gy", *base, "marks", "passed", F.sum("full").over(line).alias("full")).where("passed")
    covered = F.lit(False) if deep is None else F.col("full") >= deep
    return cells.withColumn("covered", covered).where("marks OR NOT covered").select("layer", "gx", "gy", *[c + "_base" for c in w], "covered")


def depths(outlines: DataFrame, marked: Column | None = None, deep: int | None = None) -> DataFrame:
    """(layer, x1, y1, x2, y2, left, right): pieces of ``oriented`` outlines with how many polygons lie on either side.

    left and right are structs of n, the number of polygons, and marked, that of those for which the condition ``marked`` on layer and name
    holds. What these numbers decide (unions, differences, what is covered how often) needs no names, so a piece stays a short row however many
    polygons lie around it. With ``deep`` only pieces that have less than so many polygons on a side, or where marked changes, are found, and work is left out
    where ``deep`` polygons cover everything: it follows what lies open, not the pairs of polygons.

    Sides meet in grid cells. Along a side the number on its left changes only where another side leaves or reaches it there, by that side's own
    difference of left and right; these changes are summed along each stretch of cells. The number at one place of the stretch is that of its cell
    (``_ground``), changed by the sides that lie between.
    """
    w = ["n"] if marked is None else ["n", "marked"]
    swap = (F.col("y1") > F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") > F.col("x2")))
    turned = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"], strict=True)]
    sign = F.when(swap, -1).otherwise(1)
    each = outlines.select("layer", "name", *turned, sign.alias("n"), *([] if marked is None else [F.when(marked, sign).otherwise(0).alias("marked")]))
    # sides in one place stand for one; where as many polygons lie left of it as right, nothing changes
    whole = each.groupBy("layer", *ENDS).agg(*[F.sum(c).cast("int").alias(c) for c in w]).where(" OR ".join(f"{c} <> 0" for c in w))
    whole = cut(whole.withColumn("id", F.xxhash64("layer", *ENDS)))
    tol, margin = 0.5 * 10.0**-GRID, 2 * 10.0**-GRID
    size = max(_spacing(whole) / 2, 10 * margin)  # so that cells lie whole in polygons of the usual size
    own = lambda p: [F.col(c).alias(p + c) for c in ENDS]
    px1, py1, px2, py2, qx1, qy1, qx2, qy2 = (F.col(p + c) for p in "pq" for c in ENDS)
    keys = ["layer", "gx", "gy"]
    ground = written(_ground(each, w, size, margin, deep))
    tiles = cells_crossed(whole, size, margin).join(ground.select(*keys, "covered"), keys)

    # the part of a side, from kin to kout, in each cell
    def span(c: str, g: str) -> tuple[Column, Column]:
        a, d = F.col(c + "1"), F.col(c + "2") - F.col(c + "1")
        ks = [((F.col(g) + i) * size - a) / F.when(d != 0, d) for i in (0, 1)]
        still = F.when(F.floor(a / size) == F.col(g), 0.0).otherwise(2.0)
        return F.coalesce(F.least(*ks), still), F.coalesce(F.greatest(*ks), F.lit(2.0))

    (xlo, xhi), (ylo, yhi) = span("x", "gx"), span("y", "gy")
    tiles = cut(tiles.withColumn("kin", F.greatest(xlo, ylo, F.lit(0.0))).withColumn("kout", F.least(xhi, yhi, F.lit(1.0))))
    # stretches: parts that follow each other
    side = Window.partitionBy("id").orderBy("kin")
    stretch = Window.partitionBy("id", "part")
    parts = tiles.where("kin < kout")
    if marked is not None:  # what changes in a covered cell changes along marked sides
        parts = parts.where("marked <> 0 OR NOT covered")
    parts = parts.withColumn("new", F.coalesce(F.lag("kout").over(side) != F.col("kin"), F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(side.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("k0", F.min("kin").over(stretch)).withColumn("k1", F.max("kout").over(stretch)).withColumn("widest", F.max(F.struct(F.col("kout") - F.col("kin"), "kin", "kout")).over(stretch))
    parts = parts.withColumn("ka", F.col("widest.kin") + ANCHOR * (F.col("widest.kout") - F.col("widest.kin"))).withColumn("anchored", F.col("widest.kin") == F.col("kin")).withColumn("pid", F.xxhash64("id", "part"))
    parts = cut(parts.drop("new", "part", "widest", "covered"))
    other = tiles.select(*keys, F.col("id").alias("other"), *own("q"), *w)

    mine = parts.select(*keys, "pid", "id", "kin", "kout", "ka", *own("p"), *([] if marked is None else [(F.col("marked") != 0).alias("mark")]))
    met = mine.join(other, keys).where(F.col("id") != F.col("other"))
    # of sides that lie on each other one gives the piece: a marked one if there is any
    precedes = F.col("other") < F.col("id")
    if marked is not None:
        precedes = F.when(F.col("mark") == (F.col("marked") != 0), precedes).otherwise(~F.col("mark"))
    near = (qy1 <= py2 + tol) & (py1 <= qy2 + tol) & (F.least(qx1, qx2) <= F.greatest(px1, px2) + tol) & (F.least(px1, px2) <= F.greatest(qx1, qx2) + tol)
    # neither side's ends lie both beyond the other's line; what is left meets, and that alone is worked out
    c, e, r, f = ((_leftward("p", qx1, qy1), _leftward("p", qx2, qy2)), (_leftward("q", px1, py1), _leftward("q", px2, py2)), 2 * tol * F.sqrt(_square("p")), 2 * tol * F.sqrt(_square("q")))
    near = near & (F.least(*c) <= r) & (F.greatest(*c) >= -r) & (F.least(*e) <= f) & (F.greatest(*e) >= -f)
    met = met.where(near).select("pid", "id", "other", precedes.alias("precedes"), "kin", "kout", "ka", *["p" + c for c in ENDS], *["q" + c for c in ENDS], *w)
    of_each = ", ".join(f"{c}_l int, {c}_w int, {c}_b int" for c in w)
    events = met.mapInPandas(_changes(w, tol), f"pid long, k double, x double, y double, inner int, same int, {of_each}")

    # from the cell's place to the anchor, by two ways along the axes that end on the right of the side, or above a level one
    mx, my = px1 + F.col("ka") * (px2 - px1), py1 + F.col("ka") * (py2 - py1)
    rx, ry = (F.col("gx") + PLACE_X) * size, (F.col("gy") + PLACE_Y) * size
    ex, ey, aside = qx2 - qx1, qy2 - qy1, _leftward("q", mx, my)  # rays and changes ask the same of the anchor, so they agree
    det = (px2 - px1) * ey - (py2 - py1) * ex
    upon = (aside * aside <= tol * tol * _square("q")) & (det * det <= 400 * tol * tol * F.greatest(_square("p"), _square("q")))
    y_at, x_at = lambda x: qy1 + (x - qx1) * ey / F.when(ex != 0, ex), lambda y: qx1 + (y - qy1) * ex / F.when(ey != 0, ey)
    less = lambda a, b: a.cast("int") - b.cast("int")
    over, along = F.signum(ex).cast("int"), lambda a, b, x: (a > x) != (b > x)
    upward = lambda x, top: F.when(along(qx1, qx2, x), over * less(top, y_at(x) <= ry)).otherwise(0)
    rightward = lambda y, far: F.when(along(qy1, qy2, y), -less(far, x_at(y) < rx)).otherwise(0)
    level = py1 == py2
    way = F.when(level, rightward(ry, x_at(ry) < mx) + upward(mx, upon | (aside * over > 0))).otherwise(upward(rx, y_at(rx) <= my) + rightward(my, upon | (aside < 0)))
    anchors = parts.where("anchored").join(ground.drop("covered"), keys).select(*keys, "pid", "ka", *own("p"), *[c + "_base" for c in w])
    seen = anchors.join(other, keys).withColumn("way", way).where("way <> 0").groupBy("pid").agg(*[F.sum(F.col(c) * F.col("way")).cast("int").alias(c) for c in w])

    nothing = F.lit(0)
    zero = lambda names: [nothing.alias(c) for c in names]
    point = lambda k: [F.when(F.col(k) <= 0, F.col("x1")).when(F.col(k) >= 1, F.col("x2")).otherwise(F.round(F.col("x1") + F.col(k) * (F.col("x2") - F.col("x1")), GRID)).alias("x"), F.when(F.col(k) <= 0, F.col("y1")).when(F.col(k) >= 1, F.col("y2")).otherwise(F.round(F.col("y1") + F.col(k) * (F.col("y2") - F.col("y1")), GRID)).alias("y")]
    flat = F.col("y1") == F.col("y2")
    heads = parts.where("anchored").join(ground.drop("covered"), keys).join(seen.select("pid", *[F.col(c).alias(c + "_seen") for c in w]), "pid", "left")
    first = lambda c: (F.col(c + "_base") + F.coalesce(c + "_seen", nothing)).cast("int") + F.when(flat, nothing).otherwise(F.col(c))
    begin = heads.select("pid", F.col("k0").alias("k"), *point("k0"), nothing.alias("inner"), nothing.alias("same"), *[x for c in w for x in (*zero([c + "_l"]), F.col(c).alias(c + "_w"), first(c).alias(c + "_b"))], "layer")
    end = parts.where("anchored").select("pid", F.col("k1").alias("k"), *point("k1"), nothing.alias("inner"), nothing.alias("same"), *[x for c in w for x in zero([c + "_l", c + "_w", c + "_b"])])
    rows = begin.unionByName(events, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    # changes in one place count together
    so_far = Window.partitionBy("pid").orderBy("k")
    all_of_it = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("pid", "k", "x", "y", "inner", F.max("layer").over(all_of_it).alias("layer"), F.sum("same").over(so_far).alias("others"), *[x for c in w for x in ((F.sum(c + "_b").over(all_of_it) + F.sum(c + "_l").over(so_far)).alias(c + "_left"), F.sum(c + "_w").over(so_far).alias(c + "_own"))])
    rows = rows.where("inner = 0").withColumn("to", F.lead(F.struct("x", "y")).over(so_far)).where("to IS NOT NULL AND (x <> to.x OR y <> to.y)")
    rows = rows.where("others = 0").where(" OR ".join(f"{c}_own <> 0" for c in w))
    if deep is not None:
        rows = rows.where(" OR ".join([f"n_left < {deep}", f"n_left - n_own < {deep}", *(["marked_own <> 0"] if marked is not None else [])]))
    number = lambda f: F.struct(*[(f(c) if c in w else F.lit(0).cast("long")).alias(c) for c in ("n", "marked")])
    return rows.select("layer", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("to.x").alias("x2"), F.col("to.y").alias("y2"), number(lambda c: F.col(c + "_left")).alias("left"), number(lambda c: F.col(c + "_left") - F.col(c + "_own")).alias("right"))


def pair_overlaps(outlines: DataFrame) -> DataFrame:
    """(layer, a, b, area) of every two polygons of ``oriented`` whose boxes overlap, the smaller name first; the area may be 0.

    A polygon is the sum of what lies beneath its sides, those that go left less those that go right; two polygons share the sum over their
    sides, two by two, of what lies beneath both. Polygons meet once, in the first grid cell that their boxes share; a row holds two polygons.
    """
    span = [F.min(F.least("x1", "x2")).alias("bx1"), F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("x1", "x2")).alias("bx2"), F.max(F.greatest("y1", "y2")).alias("by2")]
    side = F.when(F.col("x1") != F.col("x2"), F.struct(F.least("x1", "x2").alias("lo"), F.greatest("x1", "x2").alias("hi"), "x1", "y1", ((F.col("y2") - F.col("y1")) / F.when(F.col("x1") != F.col("x2"), F.col("x2") - F.col("x1"))).alias("slope"), F.when(F.col("x2") < F.col("x1"), 1.0).otherwise(-1.0).alias("s")))
    whole = cut(outlines.groupBy("layer", "name").agg(F.collect_list(side).alias("sides"), *span))
    mean = whole.agg(F.avg(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"))).alias("m")).first()["m"]
    size = max(mean or 1.0, 10.0**-GRID)
    cell = lambda c: F.floor(F.col(c) / size)
    tiles = whole.withColumn("gx", F.explode(F.sequence(cell("bx1"), cell("bx2")))).withColumn("gy", F.explode(F.sequence(cell("by1"), cell("by2"))))
    keys, box = ["layer", "gx", "gy"], ["bx1", "by1", "bx2", "by2"]
    one = lambda p: tiles.select(*keys, F.col("name").alias(p), F.col("sides").alias(p + "_sides"), *[F.col(c).alias(p + c) for c in box])
    met = one("a").join(one("b"), keys).where("a < b AND abx1 < bbx2 AND bbx1 < abx2 AND aby1 < bby2 AND bby1 < aby2")
    met = met.where((F.col("gx") == F.floor(F.greatest("abx1", "bbx1") / size)) & (F.col("gy") == F.floor(F.greatest("aby1", "bby1") / size)))
    base = F.greatest("aby1", "bby1")

    pairs = met.select("layer", "a", "b", base.alias("base"), "b_sides", F.explode("a_sides").alias("i")).select("layer", "a", "b", "base", "i", F.explode("b_sides").alias("j"))
    lo, hi = F.greatest("i.lo", "j.lo"), F.least("i.hi", "j.hi")
    y = lambda c, x: F.col(c + ".y1") + (F.col(x) - F.col(c + ".x1")) * F.col(c + ".slope") - F.col("base")
    ends = pairs.where(lo < hi).select("layer", "a", "b", "base", "i", "j", lo.alias("lo"), hi.alias("hi"))
    il, ih, jl, jh = y("i", "lo"), y("i", "hi"), y("j", "lo"), y("j", "hi")
    ends = ends.select("layer", "a", "b", (F.col("i.s") * F.col("j.s") * (F.col("hi") - F.col("lo"))).alias("wide"), (il + ih + jl + jh).alias("high"), (il - jl).alias("dl"), (ih - jh).alias("dh"))
    dl, dh = F.col("dl"), F.col("dh")
    gap = F.when(dl * dh >= 0, F.abs(dl + dh)).otherwise((dl * dl + dh * dh) / (F.abs(dl) + F.abs(dh)))
    return ends.groupBy("layer", "a", "b").agg(F.sum(F.col("wide") * (F.col("high") - gap) / 4).alias("area"))


def linked(outline: DataFrame) -> DataFrame:
    """Rings of an outline: layer, ring (number), points (first not repeated), area: above 0 for outer rings, below for holes.

    At a point where several pieces leave, a ring takes the sharpest turn to the left, so rings that touch in a point stay apart. The ring of
    a piece, and its place in it, are found by doubling jumps along the pieces that follow.
    """
    pieces = cut(outline.withColumn("id", F.xxhash64("layer", *ENDS)))
    arrive = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))  # back along the piece
    ends = pieces.select("layer", "id", F.col("x2").alias("x"), F.col("y2").alias("y"), arrive.alias("a"))
    leave = pieces.select("layer", F.col("id").alias("next"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("b"))
    turn = F.pmod(F.col("a") - F.col("b"), F.lit(2 * 3.141592653589793))
    follow = ends.join(leave, ["layer", "x", "y"]).groupBy("id").agg(F.min_by("next", F.struct(F.when(turn <= 1e-12, F.lit(7.0)).otherwise(turn), "next")).alias("next"))
    jump = written(follow.select("id", F.col("next").alias("hop"), F.least("id", "next").alias("low")))
    fell = True
    while fell:  # once no least id falls, none falls further on: rounds follow the longest ring, not the number of pieces
        there = jump.select(F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("low").alias("low2"))
        jump = written(jump.join(there, "hop").select("id", F.col("hop2").alias("hop"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")))
        fell = bool(jump.where("fell").limit(1).count())
    # steps back to the ring's first piece
    walk = written(follow.join(jump.select("id", "low"), "id").select("id", "low", F.when(F.col("next") == F.col("low"), None).otherwise(F.col("next")).alias("hop"), F.lit(1).alias("left")))
    while walk.where("hop IS NOT NULL").limit(1).count():
        there = walk.select(F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("left").alias("more"))
        walk = written(walk.join(there, "hop", "left").select("id", "low", F.col("hop2").alias("hop"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    rows = pieces.join(walk.select("id", "low", "left"), "id")
    rings = rows.groupBy("layer", "low").agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"), F.sum(_green()).alias("area"))
    number = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("area"), "low"))
    return rings.select("layer", number.alias("ring"), F.transform("p", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("points"), "area")


def nested(rings: DataFrame) -> DataFrame:
    """The rings of ``linked`` with ``outer``: for a hole the smallest outer ring of its layer that holds it, for others their own number.

    The hole's topmost vertex is looked up among the sides of larger outer rings of its layer.
    """
    outer, hole = rings.where("area > 0"), rings.where("area <= 0")
    n = F.size("points")
    sides = outer.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "layer", F.col("ring").alias("outer"), F.col("area").alias("size"), F.get("points", F.col("i"))["x"].alias("x1"), F.get("points", F.col("i"))["y"].alias("y1"),
        F.get("points", (F.col("i") + 1) % n)["x"].alias("x2"), F.get("points", (F.col("i") + 1) % n)["y"].alias("y2"),
    )
    # the middle of a side of the hole never is a vertex of an outer ring
    a, b = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    probe = hole.select("layer", "ring", ((a["x"] + b["x"]) / 2).alias("px"), ((a["y"] + b["y"]) / 2).alias("py"))
    y1, y2, py = F.col("y1"), F.col("y2"), F.col("py")
    cross = ((y1 > py) != (y2 > py)) & (F.col("px") < F.col("x1") + (py - y1) * (F.col("x2") - F.col("x1")) / F.when(y2 != y1, y2 - y1))
    held = probe.join(sides, "layer").groupBy("layer", "ring", "outer", "size").agg((F.count_if(cross) % 2 == 1).alias("in")).where("in")
    first = held.groupBy("layer", "ring").agg(F.min_by("outer", F.struct("size", "outer")).alias("outer"))
    return outer.withColumn("outer", F.col("ring")).unionByName(hole.join(first, ["layer", "ring"], "left").select(*rings.columns, "outer"))


def points_inside(sides: DataFrame, levels: int = 8) -> DataFrame:
    """(layer, name, x, y): a point inside each polygon, holes and several parts included.

    Levels lie in the middle between neighbouring heights of vertices of the part that spans most, the ``levels`` highest of these gaps: each
    crosses the polygon. The middle of the widest stretch inside, on any of them, is the point; of equally wide ones the lowest, then the leftmost.
    """
    keys = ["layer", "name"]
    rows = _upward(sides)
    heights = rows.select(*keys, F.col("y1").alias("y")).union(rows.select(*keys, F.col("y2"))).distinct()
    above = F.lead("y").over(Window.partitionBy(*keys).orderBy("y"))
    gaps = heights.withColumn("up", above).where("up IS NOT NULL").select(*keys, ((F.col("y") + F.col("up")) / 2).alias("level"), (F.col("up") - F.col("y")).alias("h"))
    # only gaps that some side spans, so a level never lies between two parts
    spans = rows.select(*keys, F.col("y1").alias("a"), F.col("y2").alias("b")).where("a < b")
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    some = gaps.join(spans, keys).where("a < level AND b > level").select(*keys, "level", "h").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("h"), "level"))
    some = some.withColumn("r", rank).where(F.col("r") <= levels).drop("r", "h")
    xs = rows.join(some, keys).where((y1 < F.col("level")) & (y2 > F.col("level"))).select(*keys, "level", (x1 + (F.col("level") - y1) * (x2 - x1) / (y2 - y1)).alias("x"))
    row = xs.groupBy(*keys, "level").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    k = F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)))
    stretch = row.where(F.size("xs") >= 2).withColumn("k", k).select(*keys, "level", (F.get("xs", F.col("k") + 1) - F.get("xs", F.col("k"))).alias("w"), ((F.get("xs", F.col("k") + 1) + F.get("xs", F.col("k"))) / 2).alias("x"))
    best = stretch.groupBy(*keys).agg(F.min(F.struct((-F.round("w", GRID)).alias("w"), "level", "x")).alias("m"))
    return best.select(*keys, F.col("m.x").alias("x"), F.col("m.level").alias("y"))
