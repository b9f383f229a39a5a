"""Registered queries of polygon overlay, relations as areas and bent lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netaccess.operators import elements, lines, network, overlay, shapes, spatial
from netaccess.operators.lineage import cut
from netaccess.plans import bindings as b
from netaccess.plans.bindings import NETWORK, ROUTES, SNAP
from netaccess.plans.catalogue import query
from netaccess.plans.catalogue_more import GAPS, GAPS_SQL, PTS, box_ring, rings

#: Every vector as a diamond: a box in u = x + y, v = x - y, so its area is half of that box's; all numbers are exact.
DIAMONDS = f"""{PTS}, dia AS MATERIALIZED (SELECT vec_id AS id, label, round(e1) + round(e2) AS u1, round(e1) - round(e2) AS v1, round(e1) + round(e2) + 20 + 2 * (vec_id % 30) AS u2, round(e1) - round(e2) + 30 + 2 * (vec_id % 20) AS v2 FROM pts),
us AS (SELECT label, u, lead(u) OVER (PARTITION BY label ORDER BY u) AS nu FROM (SELECT label, u1 AS u FROM dia UNION SELECT label, u2 FROM dia)),
vs AS (SELECT label, v, lead(v) OVER (PARTITION BY label ORDER BY v) AS nv FROM (SELECT label, v1 AS v FROM dia UNION SELECT label, v2 FROM dia)),
cells AS (SELECT label, (nu - u) * (nv - v) / 2 AS a, u, v, count(*) AS n, min(id) AS first FROM us JOIN vs USING (label) JOIN dia USING (label) WHERE nu IS NOT NULL AND nv IS NOT NULL AND u1 <= u AND u2 >= nu AND v1 <= v AND v2 >= nv GROUP BY ALL)"""


def diamonds(spark: SparkSession, d: str) -> DataFrame:
    """Sides (layer: the label, name: the vector)."""
    p = b.points(spark, d).select("vec_id", "label", F.round("e1").alias("a"), F.round("e2").alias("c"))
    u1, v1 = F.col("a") + F.col("c"), F.col("a") - F.col("c")
    u2, v2 = u1 + 20 + 2 * (F.col("vec_id") % 30), v1 + 30 + 2 * (F.col("vec_id") % 20)
    corner = lambda u, v: F.struct(((u + v) / 2).alias("x"), ((u - v) / 2).alias("y"))
    name = F.struct(F.col("label").alias("layer"), F.col("vec_id").cast("string").alias("name"))
    sides = spatial.ring_edges(p.select(name.alias("name"), F.array(corner(u1, v1), corner(u2, v1), corner(u2, v2), corner(u1, v2)).alias("ring")))
    return sides.select("name.layer", "name.name", "x1", "y1", "x2", "y2")


@query(f"""WITH {DIAMONDS} SELECT x.label AS layer, CAST(x.id AS VARCHAR) AS a, CAST(y.id AS VARCHAR) AS b, round((least(x.u2, y.u2) - greatest(x.u1, y.u1)) * (least(x.v2, y.v2) - greatest(x.v1, y.v1)) / 2, 4) AS area
FROM dia x JOIN dia y ON x.label = y.label AND CAST(x.id AS VARCHAR) < CAST(y.id AS VARCHAR) AND least(x.u2, y.u2) > greatest(x.u1, y.u1) AND least(x.v2, y.v2) > greatest(x.v1, y.v1)""")
def polygon_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every two polygons of a layer that overlap, with the area of their intersection."""
    return overlay.pair_overlaps(overlay.oriented(diamonds(spark, d))).withColumn("area", F.round("area", 4)).where("area > 0")


@query(f"""WITH {DIAMONDS}, one AS (SELECT label, sum((u2 - u1) * (v2 - v1) / 2) AS s FROM dia GROUP BY 1)
SELECT label AS layer, round(sum(a), 4) AS union_area, round(coalesce(sum(a) FILTER (WHERE n = 1), 0), 4) AS once, round(coalesce(sum(a) FILTER (WHERE n > 1), 0), 4) AS several, round(max(s), 4) AS single_areas FROM cells JOIN one USING (label) GROUP BY label""")
def polygon_union(spark: SparkSession, d: str) -> DataFrame:
    """Each layer's union, dissolved to rings; what one and what several of its polygons cover; and the sum of their own areas."""
    outlines = cut(overlay.oriented(diamonds(spark, d)))
    # pieces deep inside bound neither the union nor what is covered once
    f = cut(overlay.depths(outlines, deep=2))
    rings = overlay.linked(overlay.outline(f, lambda n: n["n"] > 0)).groupBy("layer").agg(F.round(F.sum("area"), 4).alias("union_area"))
    once, several = (overlay.area_where(f, on).withColumnRenamed("area", c) for c, on in (("once", lambda n: n["n"] == 1), ("several", lambda n: n["n"] > 1)))
    own = overlay.outline_areas(outlines).groupBy("layer").agg(F.round(F.sum("area"), 4).alias("single_areas"))
    return rings.join(once, "layer").join(several, "layer").join(own, "layer").select("layer", "union_area", F.round("once", 4).alias("once"), F.round("several", 4).alias("several"), "single_areas")


@query(f"""WITH {DIAMONDS}, b AS (SELECT CAST(id AS VARCHAR) AS name, label, u1, v1, u2, v2, id FROM dia), f AS (SELECT label, CAST(min(id) AS VARCHAR) AS first FROM dia GROUP BY 1),
g AS (SELECT c.label, c.a, bool_or(CAST(x.id AS VARCHAR) = f.first) AS has, count(*) AS n FROM cells c JOIN f USING (label) JOIN dia x ON x.label = c.label AND x.u1 <= c.u AND x.u2 > c.u AND x.v1 <= c.v AND x.v2 > c.v GROUP BY c.label, c.a, c.u, c.v)
SELECT label AS layer, round(sum(a) FILTER (WHERE NOT has), 4) AS rest FROM g GROUP BY label""")
def polygon_difference(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each layer's union without its polygon of the smallest id."""
    sides = diamonds(spark, d)
    first = sides.groupBy("layer").agg(F.min(F.col("name").cast("long")).cast("string").alias("first"))
    marked = sides.join(first, "layer").withColumn("name", F.when(F.col("name") == F.col("first"), F.lit("first")).otherwise(F.col("name"))).drop("first")
    pieces = overlay.depths(cut(overlay.oriented(marked)), F.col("name") == "first", deep=1)
    left = overlay.area_where(pieces, lambda n: (n["n"] > 0) & (n["marked"] == 0))
    return left.select("layer", F.round("area", 4).alias("rest"))


def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a relation: an outer square in two ways, for some a hole, a second square, or ways that close nothing."""
    p = b.points(spark, d).select("vec_id", F.round("e1").alias("x"), F.round("e2").alias("y"))
    line = lambda *ps: F.array(*[F.struct((F.col("y") + dy).alias("lat"), (F.col("x") + dx).alias("lon")) for dx, dy in ps])
    way = lambda role, ok, *ps: F.when(ok, F.struct(F.lit(role).alias("role"), line(*ps).alias("geometry")))
    closes, hole, second = F.col("vec_id") % 7 != 0, F.col("vec_id") % 3 == 0, F.col("vec_id") % 4 == 0
    members = F.array_compact(F.array(
        way("outer", F.lit(True), (0, 0), (40, 0), (40, 40)), way("outer", closes, (0, 0), (0, 40), (40, 40)), way("inner", hole, (5, 5), (15, 5), (15, 15), (5, 15), (5, 5)),
        way("outer", second & closes, (100, 0), (120, 0), (120, 20), (100, 20), (100, 0)), way("", F.lit(True), (7, 7)),
    ))
    e = F.struct(F.lit("relation").alias("type"), F.col("vec_id").alias("id"), members.alias("members"))
    return p.select(F.to_json(e).alias("element"))


@query(f"""WITH {PTS} SELECT vec_id AS id, 1600.0::DOUBLE - CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END + CASE WHEN vec_id % 4 = 0 THEN 400 ELSE 0 END AS area, 1 + CAST(vec_id % 4 = 0 AS BIGINT) AS outers, CAST(vec_id % 3 = 0 AS BIGINT) AS holes,
round(e1) + 20 AS x, round(e2) + CASE WHEN vec_id % 3 = 0 THEN 2.5 WHEN vec_id % 4 = 0 THEN 10 ELSE 20 END::DOUBLE AS y FROM pts WHERE vec_id % 7 <> 0""")
def relation_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Relations as areas with holes and several parts, and a point inside each."""
    got = elements.relation_polygons(raw_relations(spark, d), "element")
    return got.select("id", F.round("area", 4).alias("area"), "outers", "holes", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- bent lines

#: Every edge with a bend half way, and its two straight parts.
BENT = """bl AS (SELECT edge_id, cost_m, p.e1 AS x1, p.e2 AS y1, (p.e1 + q.e1) / 2 + p.e5 / 10 AS xm, (p.e2 + q.e2) / 2 + q.e6 / 10 AS ym, q.e1 AS x2, q.e2 AS y2 FROM edges JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v),
ln AS (SELECT *, sqrt((xm - x1) * (xm - x1) + (ym - y1) * (ym - y1)) AS l1, sqrt((x2 - xm) * (x2 - xm) + (y2 - ym) * (y2 - ym)) AS l2 FROM bl),
prt AS (SELECT edge_id, cost_m, x1 AS ax, y1 AS ay, xm AS bx, ym AS by_, 0.0::DOUBLE AS f0, l1 / (l1 + l2) AS f1 FROM ln UNION ALL SELECT edge_id, cost_m, xm, ym, x2, y2, l1 / (l1 + l2), 1.0::DOUBLE FROM ln)"""


def bent_lines(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d)
    at = lambda k, n: p.select(F.col("vec_id").alias(k), *[F.col(c).alias(f"{n}{c}") for c in ("e1", "e2", "e5", "e6")])
    e = b.edges(spark, d).join(at("u", "p"), "u").join(at("v", "q"), "v")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    bend = point((F.col("pe1") + F.col("qe1")) / 2 + F.col("pe5") / 10, (F.col("pe2") + F.col("qe2")) / 2 + F.col("qe6") / 10)
    return e.select("edge_id", "cost_m", F.array(point(F.col("pe1"), F.col("pe2")), bend, point(F.col("qe1"), F.col("qe2"))).alias("points"))


@query(f"""WITH {NETWORK}, {BENT}, pr AS (SELECT vec_id, e3 AS x, e4 AS y, edge_id, cost_m, ax, ay, bx, by_, f0, f1, greatest(0, least(1, ((e3 - ax) * (bx - ax) + (e4 - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM pts CROSS JOIN prt),
ds AS (SELECT vec_id, edge_id, cost_m, f0 + t * (f1 - f0) AS f, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) AS dd, ax + t * (bx - ax) AS sx, ay + t * (by_ - ay) AS sy FROM pr)
SELECT vec_id, edge_id, round(dd, 4) AS connector_m, round(f, 6) AS fraction, round(f * cost_m, 4) AS cost_to_u, round(sx, 4) AS sx, round(sy, 4) AS sy FROM ds QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dd, edge_id, f) = 1""")
def bent_snap(spark: SparkSession, d: str) -> DataFrame:
    """The nearest place on streets with bends: edge, distance, and how far along the edge it lies."""
    p = b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y"))
    got = lines.snap(p, cut(bent_lines(spark, d)))
    r = lambda c, n: F.round(c, n).alias(c)
    return got.select(F.col("point_id").alias("vec_id"), "edge_id", r("connector_m", 4), r("fraction", 6), r("cost_to_u", 4), r("sx", 4), r("sy", 4))


@query(f"""WITH {NETWORK}, {BENT}, av AS (SELECT edge_id, f, ax + (f - f0) / (f1 - f0) * (bx - ax) AS x, ay + (f - f0) / (f1 - f0) * (by_ - ay) AS y FROM prt, (VALUES (0.3::DOUBLE), (0.8::DOUBLE)) v(f) WHERE f > f0 AND f <= f1)
SELECT ln.edge_id, CAST(2 + CAST(l1 / (l1 + l2) > 0.3 AND l1 / (l1 + l2) < 0.8 AS INTEGER) AS INTEGER) AS vertices, round(0.5 * (l1 + l2), 4) AS length_m, round(a.x, 4) AS x1, round(a.y, 4) AS y1, round(z.x, 4) AS x2, round(z.y, 4) AS y2
FROM ln JOIN av a ON a.edge_id = ln.edge_id AND a.f = 0.3::DOUBLE JOIN av z ON z.edge_id = ln.edge_id AND z.f = 0.8::DOUBLE""")
def bent_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Every street from 0.3 to 0.8 of its length, its bend included where it lies between."""
    whole = cut(bent_lines(spark, d))
    got = lines.sublines(whole, whole.select("edge_id", F.lit(0.3).alias("f0"), F.lit(0.8).alias("f1")))
    end = lambda i, c: F.round(F.element_at("points", i)[c], 4)
    return got.select("edge_id", F.size("points").alias("vertices"), F.round("length_m", 4).alias("length_m"), end(1, "x").alias("x1"), end(1, "y").alias("y1"), end(-1, "x").alias("x2"), end(-1, "y").alias("y2"))


#: Segments with the distances of their ends, as service_area_segments has them; what is within 150 m; cells and samples around it.
REACHABLE = """brk AS (SELECT m.mode, e.edge_id, 0.0::DOUBLE AS f, coalesce(d, 'inf'::DOUBLE) AS d FROM edges e CROSS JOIN (VALUES ('metro'), ('bus')) m(mode) LEFT JOIN reach r ON r.mode = m.mode AND r.node = u
UNION ALL SELECT m.mode, e.edge_id, 1.0::DOUBLE, coalesce(d, 'inf'::DOUBLE) FROM edges e CROSS JOIN (VALUES ('metro'), ('bus')) m(mode) LEFT JOIN reach r ON r.mode = m.mode AND r.node = v
UNION ALL SELECT c.kind, c.edge_id, c.f, least(coalesce(du.d, 'inf'::DOUBLE) + c.f * c.cost_m, coalesce(dv.d, 'inf'::DOUBLE) + (1 - c.f) * c.cost_m, (SELECT min(s.connector_m + abs(c.f - s.f) * c.cost_m) FROM snap s WHERE s.kind = c.kind AND s.edge_id = c.edge_id))
  FROM snap c LEFT JOIN reach du ON du.mode = c.kind AND du.node = c.u LEFT JOIN reach dv ON dv.mode = c.kind AND dv.node = c.v WHERE c.kind <> 'cell' AND c.f * c.cost_m > 1e-6 AND (1 - c.f) * c.cost_m > 1e-6),
seg AS (SELECT mode, edge_id, cost_m, f AS lo, lead(f) OVER w AS hi, d AS da, lead(d) OVER w AS db FROM brk JOIN edges USING (edge_id) WINDOW w AS (PARTITION BY mode, edge_id ORDER BY f) QUALIFY db IS NOT NULL),
rr AS (SELECT mode, edge_id, lo, hi, least(greatest(150 - da, 0) / cost_m, hi - lo) AS ra, least(greatest(150 - db, 0) / cost_m, hi - lo) AS rb FROM seg),
sp AS (SELECT mode, edge_id, lo AS f0, CASE WHEN ra + rb >= hi - lo THEN hi ELSE lo + ra END AS f1 FROM rr UNION ALL SELECT mode, edge_id, hi - rb, hi FROM rr WHERE ra + rb < hi - lo),
li AS MATERIALIZED (SELECT mode, x1 + f0 * (x2 - x1) AS x1, y1 + f0 * (y2 - y1) AS y1, x1 + f1 * (x2 - x1) AS x2, y1 + f1 * (y2 - y1) AS y2 FROM sp JOIN lines USING (edge_id) WHERE f1 > f0),
cx AS (SELECT *, unnest(range(CAST(floor((least(x1, x2) - 25) / 10) AS BIGINT), CAST(floor((greatest(x1, x2) + 25) / 10) AS BIGINT) + 1)) AS gx FROM li),
cy AS (SELECT *, unnest(range(CAST(floor((least(y1, y2) - 25) / 10) AS BIGINT), CAST(floor((greatest(y1, y2) + 25) / 10) AS BIGINT) + 1)) AS gy FROM cx),
ct AS (SELECT *, greatest(0, least(1, (((gx + 0.5) * 10 - x1) * (x2 - x1) + ((gy + 0.5) * 10 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM cy),
cn AS (SELECT * FROM ct WHERE sqrt(((gx + 0.5) * 10 - x1 - t * (x2 - x1)) ** 2 + ((gy + 0.5) * 10 - y1 - t * (y2 - y1)) ** 2) <= 33),
sm AS (SELECT mode, gx, gy, i, j, x1, y1, x2, y2, gx * 10 + (i + 0.5) * 1.25 AS px, gy * 10 + (j + 0.5) * 1.25 AS py FROM cn, range(8) r(i), range(8) s(j)),
hit AS (SELECT DISTINCT mode, gx, gy, i, j FROM (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM sm) WHERE sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) <= 25)"""


@query(f"""WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES}, {REACHABLE} SELECT mode, count(*) / 64.0::DOUBLE * 100 / 1e6 AS km2, count(DISTINCT (gx, gy)) AS cells FROM hit GROUP BY mode""")
def service_area_km2(spark: SparkSession, d: str) -> DataFrame:
    """The area within 25 m of the streets that 150 m reach, by mode: a grid whose border cells count in part."""
    r = b.Routed(spark, d)
    spans = lines.reachable_spans(r.segments, r.reached, 150.0)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    straight = r.lines.select("edge_id", "cost_m", F.array(point("x1", "y1"), point("x2", "y2")).alias("points"))
    way = lines.sublines(straight, spans)
    at = lambda i, c, n: F.element_at("points", i)[c].alias(n)
    cells = lines.coverage(way.select(F.col("mode").alias("layer"), at(1, "x", "x1"), at(1, "y", "y1"), at(-1, "x", "x2"), at(-1, "y", "y2")), 25.0, 10.0)
    return cells.groupBy(F.col("layer").alias("mode")).agg((F.sum("share") * 100 / 1e6).alias("km2"), F.count("*").alias("cells"))


#: An L of two boxes that share a border, and a hole in it; the oracle adds and subtracts boxes.
L_SHAPE = [(-210.0, -190.0, 130.0, 40.0, 1), (-210.0, 40.0, 15.0, 220.0, 1), (-120.0, -90.0, -30.0, 10.0, -1)]
L_RINGS = [[(-210.0, -190.0), (130.0, -190.0), (130.0, 40.0), (15.0, 40.0), (15.0, 220.0), (-210.0, 220.0)], [(-120.0, -90.0), (-30.0, -90.0), (-30.0, 10.0), (-120.0, 10.0)]]
L_SQL = "ls(bx1, by1, bx2, by2, s) AS (VALUES " + ", ".join("(" + ", ".join(f"{v}::DOUBLE" for v in row) + ")" for row in L_SHAPE) + ")"


@query(f"""WITH {PTS}, {L_SQL}, g AS (SELECT CAST(floor(e4 / 50) AS BIGINT) AS row, CAST(floor(e3 / 50) AS BIGINT) AS col, CAST(sum(1 + vec_id % 97) AS BIGINT) AS weight FROM pts GROUP BY 1, 2),
a AS (SELECT row, col, weight, sum(s * greatest(0, least(bx2, (col + 1) * 50) - greatest(bx1, col * 50)) * greatest(0, least(by2, (row + 1) * 50) - greatest(by1, row * 50))) / 1e6 AS area_km2 FROM g, ls GROUP BY ALL)
SELECT row, col, weight, round(area_km2, 9) AS area_km2, round(weight / area_km2, 4) AS density_km2 FROM a WHERE area_km2 > 1e-12""")
def density_in_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Weights by square, cut to a boundary with a corner and a hole."""
    p = b.points(spark, d).select(F.col("e3").alias("x"), F.col("e4").alias("y"), (1 + F.col("vec_id") % 97).alias("weight"))
    boundary = rings(spark, {f"r{i}": r for i, r in enumerate(L_RINGS)})
    got = shapes.grid_clipped_by(p, boundary, 50.0)
    return got.select("row", "col", "weight", F.round("area_km2", 9).alias("area_km2"), F.round("density_km2", 4).alias("density_km2"))


@query(f"""WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES}, {GAPS_SQL}, h AS (SELECT p.vec_id, min(name) AS name FROM pts p JOIN gaps ON e3 > bx1 AND e3 < bx2 AND e4 > by1 AND e4 < by2 GROUP BY 1),
c AS (SELECT h.name, c.vec_id, c.distance FROM cell_d c JOIN h USING (vec_id) WHERE c.mode = 'metro' AND c.distance < 'inf'), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, vec_id) = 1)
SELECT b.name AS district, b.vec_id AS point_id, round(b.distance, 4) AS distance, s.edge_id, round(x1 + f * (x2 - x1), 4) AS access_x, round(y1 + f * (y2 - y1), 4) AS access_y FROM b JOIN snap s ON s.kind = 'cell' AND s.vec_id = b.vec_id""")
def district_focus(spark: SparkSession, d: str) -> DataFrame:
    """Each district's cell nearest to a station, and where it enters the network."""
    return _focus(b.Routed(spark, d), spark).select("district", "point_id", F.round("distance", 4).alias("distance"), "edge_id", F.round("sx", 4).alias("access_x"), F.round("sy", 4).alias("access_y"))


def _focus(r: b.Routed, spark: SparkSession) -> DataFrame:
    cells = r.points.select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y"))
    held = spatial.assign_polygon(cells, _districts(spark), 0.0).where("district IS NOT NULL").select("point_id", "district")
    near = r.cells().where("mode = 'metro' AND distance < double('inf')").join(held, "point_id")
    best = near.groupBy("district").agg(F.min(F.struct("distance", "point_id")).alias("m")).select("district", "m.*")
    at = r.snap.where("kind = 'cell'").select(F.col("vec_id").alias("point_id"), "edge_id", "fraction", "sx", "sy")
    return best.join(at, "point_id")


def _districts(spark: SparkSession) -> DataFrame:
    return rings(spark, {n: box_ring(x) for n, x in GAPS.items()})


@query()
def district_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from each district's nearest station to its cell: whether it leaves the district, and on which leg first."""
    r = b.Routed(spark, d)
    best = cut(_focus(r, spark))
    seg = r.segments.where("mode = 'metro'")
    on = best.join(seg, "edge_id").where("fraction >= lo AND fraction <= hi")
    end = lambda n, c: F.struct(F.col(n).alias("node"), (c * F.col("cost_m")).alias("c"))
    ends = on.select("district", F.explode(F.array(end("a", F.col("fraction") - F.col("lo")), end("b", F.col("hi") - F.col("fraction")))).alias("e"))
    reach = r.reached.where("mode = 'metro'").select("node", F.col("distance").alias("dn"))
    last = ends.select("district", "e.*").join(reach, "node").groupBy("district").agg(F.min_by("node", F.struct(F.col("dn") + F.col("c"), F.col("node"))).alias("node"))
    paths = cut(network.trace(r.reached, last.select(F.lit("metro").alias("mode"), "node")))
    legs = network.path_legs(paths, r.segments).join(last.select("node", F.col("district").alias("name")), "node")
    found = network.leaving(legs, shapes.inside_parts(r.lines, _districts(spark)))
    out = last.join(paths.select("node", F.size("path").alias("nodes")), "node").join(found.select("node", F.col("name").alias("district"), "legs", "crosses", "first_leg"), ["node", "district"], "left")
    return out.select("district", "node", "nodes", F.coalesce("legs", F.lit(0)).alias("legs"), F.coalesce("crosses", F.lit(False)).alias("crosses"), "first_leg")
