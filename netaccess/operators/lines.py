"""Linear referencing on lines of any number of vertices: parts, nearest position, position at a fraction, cuts, coverage.

Lines come as (edge_id, cost_m, points: array of x, y); a position on a line is a fraction of its length. A line without length
has one position, 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators import overlay, spatial
from netaccess.operators.lineage import cut

POINT = "struct<x:double,y:double>"
#: Border cells of a coverage that are sent to the lines' parts; more are joined by shuffling.
BORDER_CELLS = 100_000


def parts(lines: DataFrame) -> DataFrame:
    """(edge_id, part, x1, y1, x2, y2, from_f, to_f, length_m, cost_m): the straight parts with the fractions at which they start and end.

    Lines of fewer than two points, or with a point that is not finite, have no parts.
    """
    ok = (F.size("points") >= 2) & ~F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    rows = lines.where(F.col("points").isNotNull() & ok).select("edge_id", "cost_m", "points", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("part"))
    a, b = F.get("points", F.col("part")), F.get("points", F.col("part") + 1)
    rows = rows.select("edge_id", "cost_m", "part", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    rows = rows.withColumn("len", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    line = Window.partitionBy("edge_id").orderBy("part")
    upto, whole = F.sum("len").over(line), F.sum("len").over(Window.partitionBy("edge_id"))
    at = lambda x: F.when(whole > 0, x / whole).otherwise(F.lit(0.0))
    # the last part ends at 1 whatever the sums round to
    last = F.col("part") == F.max("part").over(Window.partitionBy("edge_id"))
    return rows.select("edge_id", "part", "x1", "y1", "x2", "y2", at(upto - F.col("len")).alias("from_f"), F.when(last & (whole > 0), 1.0).otherwise(at(upto)).alias("to_f"), whole.alias("length_m"), "cost_m")


def snap(points: DataFrame, lines: DataFrame, size: float = 25.0) -> DataFrame:
    """``spatial.snap_to_edges`` for lines with bends: fraction is that of the line's length; of equally near lines the smaller id counts."""
    return spatial.snap_to_edges(points, parts(lines).select("edge_id", "cost_m", "x1", "y1", "x2", "y2", "from_f", "to_f"), size)


def positions(lines: DataFrame, at: DataFrame) -> DataFrame:
    """The rows of ``at`` (edge_id, fraction, others) with x and y on their line; fractions beyond the ends stand for these, lines without parts give nulls."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    p = parts(lines).select("edge_id", "part", "x1", "y1", "x2", "y2", "from_f", "to_f", "length_m")
    held = at.withColumn("row", F.struct("*")).join(p, "edge_id").where((f >= F.col("from_f")) & (f <= F.col("to_f")) | (F.col("length_m") == 0))
    first = held.groupBy("row").agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "from_f", "to_f"), "part").alias("p"))
    g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("row.fraction")))
    t = F.when(F.col("p.to_f") > F.col("p.from_f"), (g - F.col("p.from_f")) / (F.col("p.to_f") - F.col("p.from_f"))).otherwise(F.lit(0.0))
    xy = first.select("row.*", (F.col("p.x1") + t * (F.col("p.x2") - F.col("p.x1"))).alias("x"), (F.col("p.y1") + t * (F.col("p.y2") - F.col("p.y1"))).alias("y"))
    return at.join(xy.select("edge_id", "fraction", "x", "y").distinct(), ["edge_id", "fraction"], "left")


def sublines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``spans`` (edge_id, f0, f1, others) with ``points``: the line between the two fractions, its bends included, and length_m.

    The parts that a span touches are clipped to it, each by itself; spans without length have one point twice.
    """
    p = parts(lines)
    keys = spans.columns
    touch = (F.col("to_f") >= F.col("f0")) & (F.col("from_f") <= F.col("f1"))
    rows = spans.join(p, "edge_id").where(touch)
    share = F.col("to_f") - F.col("from_f")
    t = lambda f: F.when(share > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f) - F.col("from_f")) / share))).otherwise(F.lit(0.0))
    at = lambda f: F.struct((F.col("x1") + t(f) * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t(f) * (F.col("y2") - F.col("y1"))).alias("y"))
    pieces = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", at("f0").alias("a"), at("f1").alias("b")))).alias("ps"), F.max((F.col("f1") - F.col("f0")) * F.col("length_m")).alias("length_m"))
    way = F.concat(F.array(F.get("ps", F.lit(0))["a"]), F.transform("ps", lambda x: x["b"]))
    # a part that only touches the span's end adds the same point again
    return pieces.select(*keys, F.filter(way, lambda q, i: (i == 0) | (q != F.get(way, i - 1)) | ((i == 1) & (F.size(way) == 2))).alias("points"), "length_m")


def reachable_spans(segs: DataFrame, reached: DataFrame, budget: float) -> DataFrame:
    """(mode, edge_id, f0, f1): what of each segment lies within the budget, from either of its ends; parts that meet are one.

    ``segs`` and ``reached`` as in ``network.service_area``.
    """
    d = reached.select("mode", "node", "distance")
    s = segs.join(d.toDF("mode", "a", "da"), ["mode", "a"], "left").join(d.toDF("mode", "b", "db"), ["mode", "b"], "left")
    width = F.col("hi") - F.col("lo")
    left = lambda c: F.greatest(F.lit(0.0), F.lit(budget) - F.coalesce(c, F.lit(float("inf")))) / F.col("cost_m")
    ra, rb = F.least(left("da"), width), F.least(left("db"), width)
    one = F.struct(F.col("lo").alias("f0"), F.col("hi").alias("f1"))
    two = F.array(F.struct(F.col("lo").alias("f0"), (F.col("lo") + ra).alias("f1")), F.struct((F.col("hi") - rb).alias("f0"), F.col("hi").alias("f1")))
    spans = s.select("mode", "edge_id", F.explode(F.when(ra + rb >= width, F.array(one)).otherwise(two)).alias("p")).select("mode", "edge_id", "p.f0", "p.f1")
    return spans.where("f1 > f0")


def coverage(lines: DataFrame, radius: float, size: float, fine: int = 8) -> DataFrame:
    """(layer, gx, gy, share) of grid cells of ``size`` metres that lie within ``radius`` of the layer's lines: share of the cell.

    ``lines``: layer, x1, y1, x2, y2 (straight parts). A cell whose centre lies deep inside is whole, one far out is none; of the cells on
    the border, ``fine`` times ``fine`` sample points say how much. Each part meets only the cells that it comes so near to. The cells'
    distances are summed up where the parts lie, and up to BORDER_CELLS border cells are sent there, so the many cells of the parts are not shuffled.
    """
    half = size * 0.7071067811865476
    spread = lines.select("layer", "x1", "y1", "x2", "y2").repartition(4 * lines.sparkSession.sparkContext.defaultParallelism)
    near = overlay.cells_crossed(cut(spread), size, radius)

    def gap(px, py):
        x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        l2 = dx * dx + dy * dy
        t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(l2 > 0, l2)))).otherwise(F.lit(0.0))
        return F.sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2)

    centre = gap((F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size)
    near = near.withColumn("d", centre).where(F.col("d") <= radius + half)
    cells = cut(near.groupBy("layer", "gx", "gy").agg(F.min("d").alias("d")))
    whole = cells.where(F.col("d") <= radius - half).select("layer", "gx", "gy", F.lit(1.0).alias("share"))
    rim = cells.where(F.col("d") > radius - half).select("layer", "gx", "gy")
    border = near.join(F.broadcast(rim) if rim.count() <= BORDER_CELLS else rim, ["layer", "gx", "gy"])
    step = F.sequence(F.lit(0), F.lit(fine - 1))
    dots = border.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    hit = gap(F.col("gx") * size + (F.col("i") + 0.5) * size / fine, F.col("gy") * size + (F.col("j") + 0.5) * size / fine) <= radius
    some = dots.where(hit).select("layer", "gx", "gy", "i", "j").distinct().groupBy("layer", "gx", "gy").agg((F.count("*") / float(fine * fine)).alias("share"))
    return whole.unionByName(some)


def covered_km2(cells: DataFrame, size: float) -> DataFrame:
    """(layer, km2) of a coverage."""
    return cells.groupBy("layer").agg((F.sum("share") * size * size / 1e6).alias("km2"))


def coverage_rings(cells: DataFrame, size: float, least: float = 0.5) -> DataFrame:
    """Outlines of the cells that are covered at least that much, as rings with holes (see ``overlay.linked``)."""
    inside = cut(cells.where(F.col("share") >= least).select("layer", "gx", "gy"))
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    steps = [(0, -1), (1, 0), (0, 1), (-1, 0)]  # the neighbour beyond each side, cell on the left
    sides = []
    for (a, b), (c, e), (i, j) in zip(corners, corners[1:] + corners[:1], steps, strict=True):
        beyond = inside.select("layer", (F.col("gx") - i).alias("gx"), (F.col("gy") - j).alias("gy"))
        open_ = inside.join(beyond, ["layer", "gx", "gy"], "left_anti")
        sides.append(open_.select("layer", *[((F.col(g) + o) * size).alias(n) for n, g, o in (("x1", "gx", a), ("y1", "gy", b), ("x2", "gx", c), ("y2", "gy", e))]))
    return overlay.linked(sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]))
