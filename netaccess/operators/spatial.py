"""Nearest edges and points, points in boxes, lengths in boxes. Planar metres.

Nearest searches join on grid cells, in rings that grow until the best distance is within the ring: an
equi join whose work follows the density of the data, with no cross join and nothing broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.operators import overlay
from netaccess.operators.lineage import cut


#: Places that are sent to all things (rather than dealt by cell with them) number at most this.
FEW_PLACES = 20_000


def _around(things: DataFrame, box: list, size: float, margin: float) -> DataFrame:
    """Each thing once for every grid cell (gx, gy) of its box, widened by the margin."""
    reach = lambda lo, hi: F.explode(F.sequence(F.floor((lo - margin) / size), F.floor((hi + margin) / size)))
    return things.withColumn("gx", reach(box[0], box[2])).withColumn("gy", reach(box[1], box[3]))


def _ring_search(points: DataFrame, things: DataFrame, box: list, measured, measure: list[str], best: list[str], size: float, tiled=_around) -> DataFrame:
    """For each point the nearest thing, of equally near ones the first of ``best`` (ordering columns); ``measure`` are its columns besides the distance d.

    ``measured`` adds d and these columns to pairs of a point and a thing.
    ``tiled`` puts things into the grid cells (gx, gy) of a size that they pass or come nearer to than a margin, all cells of their box unless given.

    Places and things are written once; points at one place are searched once. A cell holds a few things, or an eighth of a thing's mean
    extent if that is more, so a thing lies in a bounded number of cells however many there are. A place meets the things of its own cell: what
    is nearer than the margin is decided, the rest goes on with a margin eight times as wide, until it holds everything. Each round first finds
    the least distance, which is summed up while the join runs (no pair is sorted or written), then the thing that has it. Points or things without
    finite coordinates take no part; ``size`` is the cell where things have no extent at all.
    """
    finite = lambda *cs: reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cs])
    # every core gets things, as the work is in the pairs
    things = cut(things.where(finite(*box)).repartition(4 * things.sparkSession.sparkContext.defaultParallelism))
    points = cut(points.where(finite(F.col("px"), F.col("py"))))
    left = cut(points.select("px", "py").distinct())
    extent = F.avg(F.greatest(box[2] - box[0], box[3] - box[1]))
    facts = things.agg(F.count("*").alias("n"), F.min(box[0]).alias("x1"), F.min(box[1]).alias("y1"), F.max(box[2]).alias("x2"), F.max(box[3]).alias("y2"), extent.alias("extent")).first()
    span = left.agg(F.count("*").alias("n"), F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2")).first()
    if not facts["n"] or not span["n"]:
        return measured(points.join(things, F.lit(False))).select("point_id", "d", *measure)
    width, height = facts["x2"] - facts["x1"], facts["y2"] - facts["y1"]
    corners = [max(facts["x2"], span["x2"]), min(facts["x1"], span["x1"]), max(facts["y2"], span["y2"]), min(facts["y1"], span["y1"])]
    whole = corners[0] - corners[1] + corners[2] - corners[3]
    step = max(2 * (width * height / facts["n"]) ** 0.5, 2 * max(width, height) / facts["n"], facts["extent"] / 8) or size
    step = max(step, 1e-9 * max(map(abs, corners)))
    # long things lie denser than their number says
    margin = min(step / 2, max(4 * width * height / (facts["n"] * facts["extent"]), step / 1000)) if facts["extent"] else step / 2
    count, out = span["n"], None
    while True:
        tiles = tiled(things, box, step, margin)
        small = F.broadcast if count <= FEW_PLACES else lambda df: df
        mine = left.withColumn("gx", F.floor(F.col("px") / step)).withColumn("gy", F.floor(F.col("py") / step))
        low = measured(small(mine).join(tiles, ["gx", "gy"])).groupBy("px", "py").agg(F.min("d").alias("low"))
        last = margin > whole  # then a cell holds everything
        low = cut(low if last else low.where(F.col("low") <= 0.999 * margin))
        mine = low.withColumn("gx", F.floor(F.col("px") / step)).withColumn("gy", F.floor(F.col("py") / step))
        # exploded, as a filter on d would be computed from its parts again and again
        first = F.explode_outer(F.when(F.col("d") == F.col("low"), F.array(F.struct("d", *measure))))
        pairs = measured(small(mine).join(tiles, ["gx", "gy"])).select("px", "py", first.alias("one")).where("one IS NOT NULL")
        near = cut(pairs.select("px", "py", "one.*").groupBy("px", "py").agg(F.min_by(F.struct("*"), F.struct(*best)).alias("m")).select("m.*"))
        out = near if out is None else out.unionByName(near)
        if not last:
            left = cut(left.join(near.select("px", "py"), ["px", "py"], "left_anti"))
            count = left.count()
        if last or not count:
            every = points.join(out, ["px", "py"]).drop("px", "py")
            return every.groupBy("point_id").agg(F.min_by(F.struct("*"), F.struct(*best)).alias("m")).select("m.*")
        margin *= 8
        step = max(step, margin)


def snap_to_edges(points: DataFrame, segments: DataFrame, size: float = 25.0) -> DataFrame:
    """Nearest edge of each point: edge_id, connector_m, fraction, cost_to_u, cost_to_v, sx, sy.

    ``points``: point_id, x, y. ``segments``: edge_id, cost_m, x1, y1, x2, y2 (straight edges), and from_f, to_f where they are
    parts of bent ones (see ``lines.parts``). The nearest
    point of an edge is found by projection; an edge of no length has fraction 0; of equally near edges
    the smaller id counts, of equally near places on it the first. No edges or no points: no rows.
    """
    p = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"))
    segments = segments.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    if not segments.limit(1).count():
        return p.limit(0).select("point_id", *[F.lit(0.0).alias(c) for c in ("edge_id", "connector_m", "fraction", "cost_to_u", "cost_to_v", "sx", "sy")])
    x1, y1, x2, y2, px, py = (F.col(c) for c in ("x1", "y1", "x2", "y2", "px", "py"))
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(l2 > 0, l2)))).otherwise(F.lit(0.0))
    sx, sy = F.col("sx"), F.col("sy")
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    parts = [c for c in ("from_f", "to_f") if c in segments.columns]
    f = F.col("from_f") + F.col("t") * (F.col("to_f") - F.col("from_f")) if parts else F.col("t")

    def measured(pairs: DataFrame) -> DataFrame:
        at = pairs.withColumn("t", t).withColumn("sx", x1 + F.col("t") * dx).withColumn("sy", y1 + F.col("t") * dy)
        return at.withColumn("d", F.sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy))).withColumn("t", f)

    # of edges in one place the first stands for all
    own = segments.groupBy("x1", "y1", "x2", "y2").agg(F.min(F.struct("edge_id", *parts, "cost_m")).alias("e")).select("x1", "y1", "x2", "y2", "e.*")
    got = _ring_search(p, own, box, measured, ["edge_id", "t", "cost_m", "sx", "sy"], ["d", "edge_id", "t"], size, lambda rows, _, step, margin: overlay.cells_crossed(rows, step, margin))
    return got.select("point_id", "edge_id", F.col("d").alias("connector_m"), F.col("t").alias("fraction"), (F.col("t") * F.col("cost_m")).alias("cost_to_u"), ((1 - F.col("t")) * F.col("cost_m")).alias("cost_to_v"), "sx", "sy")


def nearest_points(points: DataFrame, targets: DataFrame, size: float = 25.0) -> DataFrame:
    """(point_id, target_id, distance) of the nearest target (target_id, x, y), ties to the smaller id."""
    p = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"))
    t = targets.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("target_id").alias("target_id"))
    d = F.sqrt((F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty")))
    box = [F.col("tx"), F.col("ty"), F.col("tx"), F.col("ty")]
    got = _ring_search(p, t, box, lambda pairs: pairs.withColumn("d", d), ["target_id"], ["d", "target_id"], size)
    return got.select("point_id", "target_id", F.col("d").alias("distance"))


def with_fallback(entrances: DataFrame, stations: DataFrame, radius: float = 400.0) -> DataFrame:
    """All entrances, and stations with no entrance within the radius, with the reason."""
    near = nearest_points(stations.select(F.col("target_id").alias("point_id"), "x", "y"), entrances)
    far = stations.join(near.where(F.col("distance") <= radius), stations.target_id == near.point_id, "left_anti")
    a = entrances.select("target_id", F.lit("entrance").alias("kind"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(far.select("target_id", F.lit("station").alias("kind"), F.lit(f"no entrance within {radius:g} m").alias("reason")))


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Polygons (name, ring: array of x, y) to sides."""
    nexts = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    sides = polygons.select("name", F.explode(F.arrays_zip(F.col("ring").alias("a"), nexts.alias("b"))).alias("s"))
    return sides.select("name", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def band_height(sides: DataFrame) -> float:
    """Height of row bands in which a side lies in few: about its mean height."""
    return max(sides.agg(F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("h")).first()["h"] or 0.0, 1e-6)


def held_by(points: DataFrame, sides: DataFrame, tolerance: float = 0.0, on: list[str] | None = None) -> DataFrame:
    """(point_id, name, inside, edge) of the polygons around each point: inside by the even-odd rule, edge within the tolerance of a side.

    Points meet the sides of their row band, by equality (and by ``on``, such as the name): a ray to the right crosses no others. No
    boxes are compared and nothing is broadcast; work follows the sides of a band. Pairs with neither are left out.
    """
    px, py = F.col("x"), F.col("y")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    size, e, keys = band_height(sides), tolerance, on or []
    cross = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1).otherwise(F.lit(1.0)))
    l2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / F.when(l2 > 0, l2).otherwise(F.lit(1.0))))
    gap = F.sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)
    band = F.sequence(F.floor((F.least(y1, y2) - e) / size), F.floor((F.greatest(y1, y2) + e) / size))
    rows = sides.select("name", "x1", "y1", "x2", "y2").withColumn("band", F.explode(band))
    ours = points.select("point_id", *keys, "x", "y").where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)).withColumn("band", F.floor(py / size))
    met = ours.join(rows, ["band", *keys]).where(px <= F.greatest(x1, x2) + e)
    met = met.select("point_id", "name", cross.alias("c"), (gap <= e).alias("g")).where("c OR g")
    per = met.groupBy("point_id", "name").agg((F.count_if("c") % 2 == 1).alias("inside"), F.max("g").alias("edge"))
    return per.where("inside OR edge")


def assign_polygon(points: DataFrame, sides: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """The polygon of each point: within (exactly one), boundary_tie (several, or within the tolerance of one's side; the first name), else outside."""
    per = held_by(points, sides, tolerance)
    got = per.groupBy("point_id").agg(F.count_if(F.col("inside") & ~F.col("edge")).alias("n_in"), F.count("*").alias("n"), F.min("name").alias("first"))
    out = points.select("point_id").join(got, "point_id", "left")
    method = F.when(F.col("n").isNull(), "outside").when((F.col("n") == 1) & (F.col("n_in") == 1), "within").otherwise("boundary_tie")
    return out.select("point_id", F.col("first").alias("district"), method.alias("method"))


def clip_to_boxes(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(edge_id, name, f0, f1, length_m): the part of each straight edge inside each box (Liang-Barsky)."""
    x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def span(start, delta, lo, hi):
        one = F.when(delta == 0, F.when((start >= lo) & (start <= hi), F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least((lo - start) / F.when(delta != 0, delta), (hi - start) / F.when(delta != 0, delta)))
        two = F.when(delta == 0, F.lit(1.0)).otherwise(F.greatest((lo - start) / F.when(delta != 0, delta), (hi - start) / F.when(delta != 0, delta)))
        return one, two

    ax, bx = span(x1, dx, F.col("bx1"), F.col("bx2"))
    ay, by = span(y1, dy, F.col("by1"), F.col("by2"))
    f0, f1 = F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)
    touch = (F.greatest("x1", "x2") >= F.col("bx1")) & (F.least("x1", "x2") <= F.col("bx2")) & (F.greatest("y1", "y2") >= F.col("by1")) & (F.least("y1", "y2") <= F.col("by2"))
    out = edges.join(boxes, touch).select("edge_id", "name", f0.alias("f0"), f1.alias("f1"), F.sqrt(dx * dx + dy * dy).alias("len"))
    return out.where("f1 > f0").select("edge_id", "name", "f0", "f1", ((F.col("f1") - F.col("f0")) * F.col("len")).alias("length_m"))


def partition_lengths(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edge length by box with shared stretches counted once, for the first name: (name, length_km, shared_km).

    An edge's parts in boxes are cut at all their ends; each piece counts for the smallest name that covers
    it. shared_km is the length in the box that other boxes also cover.
    """
    parts = clip_to_boxes(edges, boxes)
    cuts = parts.groupBy("edge_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("f0", "f1"))))).alias("cuts"), F.max((F.col("length_m")) / (F.col("f1") - F.col("f0"))).alias("len"))
    pieces = cuts.select("edge_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("lo"), F.element_at("cuts", i + 1).alias("hi")))).alias("p"))
    own = pieces.join(parts, "edge_id").where((F.col("f0") <= F.col("p.lo")) & (F.col("f1") >= F.col("p.hi")))
    per = own.groupBy("edge_id", "p", "len").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    metres = (F.col("p.hi") - F.col("p.lo")) * F.col("len")
    return per.groupBy("name").agg(F.round(F.sum(metres) / 1000, 6).alias("length_km"), F.round(F.sum(F.when(F.col("n") > 1, metres).otherwise(0.0)) / 1000, 6).alias("shared_km"))
