"""Further registered queries: elements and layers, guarded joins, shapes, ledgers, checks and composites, with their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netaccess.functions import text
from netaccess.operators import access, checks, elements, ledger, network, places, relate, shapes, spatial, temporal
from netaccess.plans import bindings as b
from netaccess.plans.bindings import ANNUAL, CELLS, GRID, NETWORK, SNAP, STATIONS, YEARS, table
from netaccess.plans.catalogue import BOXES, BUDGET, BUDGET_SQL, PCTS, SEGMENTS, STATES, _raw_and_control, _sums, query

PTS = "pts AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) * 1000 AS e{i}" for i in range(1, 7)) + " FROM embeddings)"


def rings(spark: SparkSession, polygons: dict[str, list[tuple[float, float]]]) -> DataFrame:
    rows = [(n, [(float(x), float(y)) for x, y in ring]) for n, ring in polygons.items()]
    return spatial.ring_edges(spark.createDataFrame(rows, "name string, ring array<struct<x: double, y: double>>"))


# --- elements

def raw_elements(spark: SparkSession, d: str) -> DataFrame:
    """Points as map elements: nodes, triangles and lines as ways, relations with and without a centre; some come twice."""
    p = b.points(spark, d).select("vec_id", "label", "e1", "e2")
    at = lambda dx, dy: F.struct((F.col("e2") + dy).alias("lat"), (F.col("e1") + dx).alias("lon"))
    m, even = F.col("vec_id") % 3, F.col("vec_id") % 2 == 0
    kind = F.when(m == 0, "node").when(m == 1, "way").otherwise("relation")
    shape = F.when((m == 1) & even, F.array(at(0, 0), at(30, 0), at(0, 40), at(0, 0))).when(m == 1, F.array(at(0, 0), at(30, 40)))
    center = F.when((m == 2) & (F.col("vec_id") % 4 != 0), F.struct(F.col("e2").alias("lat"), F.col("e1").alias("lon")))
    tags = F.map_filter(
        F.create_map(
            F.lit("amenity"), F.when(F.col("label") < 4, "Clinic ").when(F.col("label") < 6, "school"), F.lit("building"), F.when(F.col("label") % 2 == 0, "school"),
            F.lit("name"), F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit(" Place  "), "vec_id")), F.lit("station"), F.when(F.col("vec_id") % 11 == 0, "subway"),
            F.lit("railway"), F.when(F.col("vec_id") % 22 == 0, "subway_entrance"), F.lit("highway"), F.when(F.col("vec_id") % 13 == 0, "bus_stop"),
            F.lit("public_transport"), F.when(F.col("vec_id") % 7 == 0, "platform"), F.lit("bus"), F.when(F.col("vec_id") % 14 == 0, "yes"),
        ),
        lambda k, v: v.isNotNull(),
    )
    e = F.struct(kind.alias("type"), F.col("vec_id").alias("id"), F.when(m == 0, F.col("e2")).alias("lat"), F.when(m == 0, F.col("e1")).alias("lon"), center.alias("center"), shape.alias("geometry"), tags.alias("tags"))
    once = p.select(F.to_json(e).alias("element"), "vec_id")
    return once.unionByName(once.where("vec_id % 10 = 1")).select("element")


ELEMENTS = f"""{PTS}, el AS (SELECT vec_id AS id, label, e1, e2, CASE vec_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type,
  CASE WHEN vec_id % 3 = 0 THEN 'node' WHEN vec_id % 3 = 1 AND vec_id % 2 = 0 THEN 'closed_way' WHEN vec_id % 3 = 1 THEN 'open_way' WHEN vec_id % 4 <> 0 THEN 'relation_center' END AS method,
  CASE WHEN label < 4 THEN 'clinic' WHEN label < 6 OR label % 2 = 0 THEN 'school' END AS category, CASE WHEN vec_id % 5 <> 0 THEN 'Place ' || vec_id END AS name FROM pts),
els AS (SELECT *, CASE method WHEN 'closed_way' THEN 0 WHEN 'open_way' THEN 1 ELSE 2 END AS rank,
  CASE method WHEN 'closed_way' THEN e1 + 7.5::DOUBLE WHEN 'open_way' THEN e1 + 15 ELSE e1 END AS x, CASE method WHEN 'closed_way' THEN e2 + 20 WHEN 'open_way' THEN e2 + 20 ELSE e2 END AS y FROM el WHERE method IS NOT NULL)"""


@query(f"""WITH {ELEMENTS} SELECT type, id, method, rank, round(x, 4) AS x, round(y, 4) AS y, id % 11 = 0 AND id % 22 <> 0 AS station, id % 22 = 0 AS entrance,
id % 13 = 0 OR (id % 14 = 0 AND id % 22 <> 0) AS bus_stop, CASE WHEN id % 13 = 0 OR id % 7 = 0 THEN 'platform' ELSE 'stop_position' END AS role, CASE WHEN type = 'node' THEN 0 ELSE 2 END + CASE WHEN name IS NULL THEN 1 ELSE 0 END AS priority FROM els""")
def map_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of JSON to one geometry, one point and the transit rules' verdicts."""
    e = elements.elements(raw_elements(spark, d), "element")
    name = text.normalised_name(elements.tag("name"))
    return e.select(
        "type", "id", "method", "rank", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), elements.is_metro_station().alias("station"), elements.is_metro_entrance().alias("entrance"),
        elements.is_bus_stop().alias("bus_stop"), elements.stop_role().alias("role"), elements.keep_priority(F.col("type"), name).alias("priority"),
    )


@query(f"""WITH {ELEMENTS} SELECT category, count(*) AS n, count(name) AS named, CAST(count_if(name IS NULL) AS BIGINT) AS unnamed, CAST(count_if(type = 'relation') AS BIGINT) AS relations, CAST(count_if(rank = 0) AS BIGINT) AS polygons FROM els WHERE category IS NOT NULL GROUP BY category""")
def facility_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Facilities by the precedence of their tags, counted by category."""
    return elements.tallies(elements.classified(raw_elements(spark, d), "element", ["amenity", "building"], ["clinic", "school"]))


@query("""WITH p AS (SELECT p_partkey AS id, [lower(p_brand), lower(p_name)] AS keys FROM part), c AS (SELECT * FROM (VALUES (1, ['brand#2', 'gold ring']), (2, ['red widget', '']), (3, ['small ring', 'brand#17']), (4, [NULL])) t(id, keys))
SELECT DISTINCT p.id AS left_id, CAST(c.id AS BIGINT) AS right_id FROM p, c WHERE len(list_intersect(p.keys, list_filter(c.keys, lambda k: k IS NOT NULL AND k <> ''))) > 0""")
def shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share a name variant with a curated list (an inline table)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.lower("p_brand"), F.lower("p_name")).alias("keys"))
    c = spark.createDataFrame([(1, ["brand#2", "gold ring"]), (2, ["red widget", ""]), (3, ["small ring", "brand#17"]), (4, [None])], "id long, keys array<string>")
    return relate.sharing(p, c)


# --- polygons

GAPS = {"a_west": (-180.0, -180.0, -20.0, 150.0), "b_middle": (-40.0, -160.0, 60.0, 20.0), "c_east": (90.0, -200.0, 190.0, 200.0)}
GAPS_SQL = "gaps(name, bx1, by1, bx2, by2) AS (VALUES " + ", ".join(f"('{n}', " + ", ".join(f"{v}::DOUBLE" for v in box) + ")" for n, box in GAPS.items()) + ")"


def box_ring(box: tuple) -> list:
    x1, y1, x2, y2 = box
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


@query(f"""WITH {PTS}, {GAPS_SQL}, j AS (SELECT vec_id, name, greatest(bx1 - e3, e3 - bx2, 0) AS dx, greatest(by1 - e4, e4 - by2, 0) AS dy FROM pts, gaps), k AS (SELECT vec_id, name, sqrt(dx * dx + dy * dy) AS d FROM j)
SELECT vec_id AS point_id, arg_min(name, (d, name)) AS district, CASE WHEN min(d) = 0 THEN 'within' ELSE 'nearest' END AS method FROM k GROUP BY vec_id""")
def attach_district(spark: SparkSession, d: str) -> DataFrame:
    """The first district that holds a point, else the nearest: no point is left out."""
    p = b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y"))
    return relate.with_nearest_polygon(p, rings(spark, {n: box_ring(x) for n, x in GAPS.items()}))


@query(f"""WITH {PTS}, j AS (SELECT a.vec_id AS point_id, t.vec_id AS target_id, sqrt((a.e1 - t.e1) * (a.e1 - t.e1) + (a.e2 - t.e2) * (a.e2 - t.e2)) AS d FROM pts a, pts t WHERE a.vec_id % 4 <> 0 AND t.vec_id % 4 = 0),
n AS (SELECT * FROM j WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, target_id) = 1)
SELECT vec_id AS point_id, target_id, round(d, 4) AS distance FROM pts LEFT JOIN n ON point_id = vec_id WHERE vec_id % 4 <> 0""")
def nearest_within_radius(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d).select("vec_id", F.col("e1").alias("x"), F.col("e2").alias("y"))
    got = relate.nearest_within(p.where("vec_id % 4 <> 0").withColumnRenamed("vec_id", "point_id"), p.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "target_id"), 60.0)
    return got.withColumn("distance", F.round("distance", 4))


#: Convex polygons: the oracle clips by half planes, the operator by crossings.
CONVEX = {"p_five": [(-150.0, -60.0), (0.0, -170.0), (160.0, -40.0), (90.0, 150.0), (-110.0, 130.0)], "q_tri": [(0.0, -10.0), (210.0, 20.0), (40.0, 190.0)]}
SIDES_SQL = "sides(name, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{n}', {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for n, ring in CONVEX.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) + ")"
CLIPPED = f"""{NETWORK}, {SIDES_SQL}, l AS (SELECT edge_id, p.e1 AS ax, p.e2 AS ay, q.e1 - p.e1 AS dx, q.e2 - p.e2 AS dy FROM edges JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v),
hp AS (SELECT edge_id, name, sqrt(dx * dx + dy * dy) AS len, (x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1) AS n0, (x2 - x1) * dy - (y2 - y1) * dx AS n1 FROM l, sides),
cl AS (SELECT edge_id, name, len, greatest(0, coalesce(max(CASE WHEN n1 > 0 THEN -n0 / n1 END), 0)) AS f0, least(1, coalesce(min(CASE WHEN n1 < 0 THEN -n0 / n1 END), 1)) AS f1 FROM hp GROUP BY ALL),
parts AS (SELECT * FROM cl WHERE f1 > f0)"""


@query(f"WITH {CLIPPED} SELECT name, round(sum((f1 - f0) * len) / 1000, 6) AS length_km FROM parts GROUP BY name")
def polygon_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of the network inside polygons of any shape, each by itself."""
    parts = shapes.inside_parts(b.edge_lines(spark, d), rings(spark, CONVEX))
    return shapes.lengths(parts).withColumn("length_km", F.round("length_km", 6))


@query(f"""WITH {CLIPPED}, w AS (SELECT edge_id, max(len) AS len, max(CASE WHEN name = 'p_five' THEN f0 END) AS a0, max(CASE WHEN name = 'p_five' THEN f1 END) AS a1, max(CASE WHEN name = 'q_tri' THEN f0 END) AS b0, max(CASE WHEN name = 'q_tri' THEN f1 END) AS b1 FROM parts GROUP BY edge_id),
o AS (SELECT *, CASE WHEN a0 IS NULL OR b0 IS NULL THEN 0 ELSE greatest(0, least(a1, b1) - greatest(a0, b0)) END AS ov FROM w), v AS (SELECT sum((a1 - a0) * len) AS a, sum((b1 - b0 - ov) * len) AS b, sum(ov * len) AS s FROM o)
SELECT 'p_five' AS name, round(a / 1000, 6) AS length_km, round(s / 1000, 6) AS shared_km, round((a + b) / 1000, 6) AS union_km FROM v UNION ALL SELECT 'q_tri', round(b / 1000, 6), 0.0::DOUBLE, round((a + b) / 1000, 6) FROM v""")
def polygon_length_partition(spark: SparkSession, d: str) -> DataFrame:
    """The same with what both cover counted for the first, and the length in their union as a control."""
    own = shapes.shared_once(shapes.inside_parts(b.edge_lines(spark, d), rings(spark, CONVEX)))
    every = own.agg(F.sum("length_km").alias("u"))
    return own.crossJoin(F.broadcast(every)).select("name", F.round("length_km", 6).alias("length_km"), F.round("shared_km", 6).alias("shared_km"), F.round("u", 6).alias("union_km"))


@query(f"WITH {SIDES_SQL} SELECT name, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, min(x1) AS bx1, min(y1) AS by1, max(x1) AS bx2, max(y1) AS by2 FROM sides GROUP BY name")
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    s = rings(spark, CONVEX)
    return shapes.areas(s).withColumn("area", F.round("area", 6)).join(shapes.boxes(s), "name")


RASTER = f"""{PTS}, raster AS (SELECT CAST(floor((250 - e4) / 20) AS BIGINT) AS row, CAST(floor((e3 + 250) / 20) AS BIGINT) AS col, sum(CASE WHEN vec_id % 9 <> 0 THEN 1 + vec_id % 97 END) AS value FROM pts GROUP BY 1, 2)"""


def raster(spark: SparkSession, d: str) -> DataFrame:
    value = F.sum(F.when(F.col("vec_id") % 9 != 0, 1 + F.col("vec_id") % 97)).cast("double").alias("value")
    return b.points(spark, d).groupBy(F.floor((250 - F.col("e4")) / 20).alias("row"), F.floor((F.col("e3") + 250) / 20).alias("col")).agg(value)


@query(f"""WITH {RASTER}, {SIDES_SQL}, c AS (SELECT row, col, value, -250 + (col + 0.5::DOUBLE) * 20 AS x, 250 - (row + 0.5::DOUBLE) * 20 AS y FROM raster WHERE value IS NOT NULL),
h AS (SELECT row, col, value, name, min((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) AS m FROM c, sides GROUP BY ALL), f AS (SELECT row, col, value, min(name) AS name FROM h WHERE m >= 0 GROUP BY ALL)
SELECT name, count(*) AS cells, CAST(sum(value) AS DOUBLE) AS total FROM f GROUP BY name""")
def zonal_sums(spark: SparkSession, d: str) -> DataFrame:
    """A raster's cells by the polygon that holds their centre, nodata left out."""
    return shapes.zonal(raster(spark, d), rings(spark, CONVEX), -250.0, 250.0, 20.0, 25, 25)


@query(f"""WITH {PTS}, bx AS (SELECT min(e3) AS x1, min(e4) AS y1, max(e3) AS x2, max(e4) AS y2 FROM pts WHERE label = 3)
SELECT CAST(greatest(floor((600 - y2) / 20), 0) AS BIGINT) AS row, CAST(greatest(floor((x1 + 600) / 20), 0) AS BIGINT) AS col, CAST(least(ceil((600 - y1) / 20), 60) - greatest(floor((600 - y2) / 20), 0) AS BIGINT) AS height, CAST(least(ceil((x2 + 600) / 20), 60) - greatest(floor((x1 + 600) / 20), 0) AS BIGINT) AS width FROM bx""")
def analysis_window(spark: SparkSession, d: str) -> DataFrame:
    box = shapes.bounding_box(b.points(spark, d).where("label = 3"), "e3", "e4")
    w = shapes.window_of(box, -600.0, 600.0, 20.0, 60, 60)
    return w.select(*[F.col(c).cast("long").alias(c) for c in w.columns])


@query("""WITH p AS (SELECT CAST(embedding[3] AS DOUBLE) * 1000 AS x, CAST(embedding[4] AS DOUBLE) * 1000 AS y, 1 + vec_id % 97 AS weight FROM embeddings),
g AS (SELECT CAST(floor(y / 90) AS BIGINT) AS row, CAST(floor(x / 90) AS BIGINT) AS col, CAST(sum(weight) AS BIGINT) AS weight FROM p GROUP BY 1, 2 HAVING sum(weight) > 0),
k AS (SELECT *, greatest(0, least(120, (col + 1) * 90) - greatest(-130, col * 90)) * greatest(0, least(140, (row + 1) * 90) - greatest(-100, row * 90)) / 1e6 AS area_km2 FROM g)
SELECT row, col, weight, area_km2, round(100.0::DOUBLE * (sum(weight) OVER ()) / (SELECT sum(weight) FROM p), 6) AS retained_pct, round(weight / area_km2, 6) AS density_km2 FROM k WHERE area_km2 > 0""")
def clipped_density_grid(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d).select(F.col("e3").alias("x"), F.col("e4").alias("y"), (1 + F.col("vec_id") % 97).alias("weight"))
    return shapes.clipped_grid(p, (-130.0, -100.0, 120.0, 140.0), 90.0)


# --- network

@query(f"""WITH {NETWORK}, rr AS (SELECT e.u, e.v, CAST(round(p.e1) AS BIGINT) AS ax, CAST(round(p.e2) AS BIGINT) AS ay, CAST(round(q.e1) AS BIGINT) AS bx, CAST(round(q.e2) AS BIGINT) AS by_, cost FROM
 (SELECT u, v, sqrt((p.e1 - q.e1) * (p.e1 - q.e1) + (p.e2 - q.e2) * (p.e2 - q.e2)) AS cost FROM rec JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v) e JOIN pts p ON p.vec_id = least(u, v) JOIN pts q ON q.vec_id = greatest(u, v))
SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(cost), 4) AS cost_m, 'LINESTRING (' || ax || ' ' || ay || ', ' || bx || ' ' || by_ || ')' AS wkt, 2 * count(*) AS records FROM rr WHERE cost > 0 GROUP BY least(u, v), greatest(u, v), round(cost, 6), ax, ay, bx, by_""")
def canonical_lines(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their lines, from records of both directions."""
    r = b.edge_records(spark, d)
    p = b.points(spark, d).select("vec_id", F.concat_ws(" ", F.round("e1").cast("long"), F.round("e2").cast("long")).alias("at"))
    r = r.join(p.toDF("u", "pu"), "u").join(p.toDF("v", "pv"), "v")
    line = lambda a, z: F.concat(F.lit("LINESTRING ("), F.col(a), F.lit(", "), F.col(z), F.lit(")")).alias("wkt")
    both = r.select("u", "v", "cost", line("pu", "pv")).unionByName(r.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", line("pv", "pu")))
    return network.canonical_lines(both).withColumn("cost_m", F.round("cost_m", 4)).select("u", "v", "cost_m", "wkt", "records")


@query(f"WITH {NETWORK} SELECT records, count(*) AS edges FROM edges GROUP BY records")
def backing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return network.backing_histogram(b.edges(spark, d))


@query(f"""WITH {NETWORK}, {SNAP}, n AS (SELECT kind, edge_id, count(*) AS m, count_if(least(f, 1 - f) * cost_m <= 1) AS e FROM snap GROUP BY ALL)
SELECT kind, CAST(sum(m) AS BIGINT) AS points, CAST(sum(e) AS BIGINT) AS endpoint, CAST(sum(m) - sum(e) AS BIGINT) AS interior, count(*) AS edges, max(m) AS most FROM n GROUP BY kind""")
def snap_placements(spark: SparkSession, d: str) -> DataFrame:
    snap = b.Routed(spark, d).snap
    return ledger.placements(snap, "kind")


@query(f"""WITH {NETWORK}, {SNAP} SELECT kind AS mode, vec_id, round(x1 + f * (x2 - x1), 3) AS x, round(y1 + f * (y2 - y1), 3) AS y FROM snap WHERE kind = 'metro' AND f * cost_m > 1e-6 AND (1 - f) * cost_m > 1e-6""")
def spliced_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Where the nodes lie that the active sources add to the network; a subset of all snaps."""
    r = b.Routed(spark, d)
    active = r.snap.where("kind = 'metro'").select("point_id")
    one = network.snap_subset(r.snap, active)
    nodes = network.spliced_xy(r.spliced.where("mode = 'metro'"), r.lines)
    key = r.spliced.where("mode = 'metro'").select("mode", "node", "edge_id", "fraction").distinct()
    named = one.select("vec_id", "edge_id", F.col("fraction").alias("f")).join(key, "edge_id").where("abs(f - fraction) * 1000 <= 1e-6")
    return named.join(nodes, ["mode", "node"]).select("mode", "vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# --- guarded joins and ledgers

@query("""SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS match_key, n_nationkey AS district, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def matched_names(spark: SparkSession, d: str) -> DataFrame:
    """Two spellings of the same names joined on their match keys; a key of one side only would raise."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("district"), F.concat(F.lit(" "), F.upper("n_name"), F.lit("’")).alias("spelt"))
    z = relate.validated(n, table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], validate="m:1")
    z = z.select(F.regexp_replace("n_name", "_", " - ").alias("other"), F.col("r_name").alias("region"))
    return relate.keyed_both_ways(a, z, text.match_key(F.col("spelt")), text.match_key(F.col("other"))).select("match_key", "district", "region")


@query("SELECT n_nationkey AS district, 'R-' || n_regionkey AS code, 'NATION_' || n_nationkey AS name FROM nation WHERE starts_with(n_name, 'NATION_1') AND length(n_name) > 8")
def crosswalk_codes(spark: SparkSession, d: str) -> DataFrame:
    n = ledger.prefixed(table(spark, d, "nation"), "n_name", "NATION_1", 8)
    return n.select(F.col("n_nationkey").alias("district"), relate.crosswalk({str(i): f"R-{i}" for i in range(5)}, F.col("n_regionkey")).alias("code"), F.col("n_name").alias("name"))


@query(f"""WITH {ANNUAL}, {CELLS}, s AS (SELECT district, year, sum(value) AS total, count(*) AS cells FROM annual JOIN cells USING (cell_id) GROUP BY ALL), f AS (SELECT district, year, 1000 * floor(total / 1000) AS total, cells FROM s WHERE district <> 3), g AS (SELECT * FROM s WHERE district <> 4)
SELECT coalesce(f.district, g.district) AS district, coalesce(f.year, g.year) AS year, CASE WHEN g.year IS NULL THEN 'frozen' WHEN f.year IS NULL THEN 'fresh' ELSE 'both' END AS side, round(g.total - f.total, 2) AS total_diff,
coalesce(abs(g.total - f.total) <= 500, false) AS total_ok, CAST(g.cells - f.cells AS DOUBLE) AS cells_diff, coalesce(abs(g.cells - f.cells) <= 500, false) AS cells_ok FROM f FULL JOIN g ON f.district = g.district AND f.year = g.year""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Frozen against recomputed sums by district and year, with keys that only one side has."""
    j = b.annual(spark, d).join(b.cells(spark, d).select("cell_id", "district"), "cell_id")
    s = j.groupBy("district", "year").agg(F.sum("value").alias("total"), F.count("*").alias("cells"))
    frozen = s.where("district <> 3").withColumn("total", 1000.0 * F.floor(F.col("total") / 1000))
    return relate.reconciled(frozen, s.where("district <> 4"), ["district", "year"], ["total", "cells"], 500.0).withColumn("total_diff", F.round("total_diff", 2))


@query(f"""WITH {ANNUAL}, {CELLS}, v AS (SELECT cell_id, district, year, CASE WHEN cell_id % 17 = 0 THEN NULL ELSE value END AS value FROM annual JOIN cells USING (cell_id)), p AS (SELECT district, year, 1000 * count(*) AS published FROM v GROUP BY ALL), s AS (SELECT district, year, sum(value) AS t FROM v GROUP BY ALL HAVING sum(value) > 0)
SELECT cell_id, year, round(value * published / t, 4) AS scaled FROM v JOIN p USING (district, year) JOIN s USING (district, year)""")
def scaled_to_published(spark: SparkSession, d: str) -> DataFrame:
    """Yearly values brought to each district's published total, missing ones kept missing."""
    v = b.annual(spark, d).join(b.cells(spark, d).select("cell_id", "district"), "cell_id").withColumn("value", F.when(F.col("cell_id") % 17 != 0, F.col("value")))
    published = v.groupBy("district", "year").agg((1000 * F.count("*")).alias("published"))
    return ledger.scaled_to(v, published, ["district", "year"], "value", "published").select("cell_id", "year", F.round("scaled", 4).alias("scaled"))


@query("WITH d AS (SELECT c_nationkey AS code, round(sum(c_acctbal) / 1000, 3) AS t FROM customer GROUP BY 1) SELECT CAST(code AS VARCHAR) AS code, CAST(round(t * 1000) AS BIGINT) AS people FROM d")
def official_totals(spark: SparkSession, d: str) -> DataFrame:
    """People from thousands; the districts must add up to the city's row."""
    t = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(F.round(F.sum("c_acctbal") / 1000, 3).alias("p2026"))
    t = b_written(spark, t)
    city = t.agg(F.lit("city").alias("code"), F.sum("p2026").alias("p2026"))
    return ledger.official_totals(t.unionByName(city), "code", "p2026", "city")


def b_written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Lineage cut, for results that guards and later steps read again."""
    from netaccess.operators.lineage import cut

    return cut(df)


@query("SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return ledger.top_counts(table(spark, d, "part").select(F.col("p_type").alias("value")), "value", 6)


@query(f"WITH {CELLS}, s AS (SELECT district, round(100.0::DOUBLE * sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN weight ELSE 0 END) / sum(weight), 6) AS metro_pct FROM cells GROUP BY 1) SELECT n_name AS name, metro_pct, CAST(row_number() OVER (ORDER BY metro_pct DESC, n_name) AS INTEGER) AS rank FROM s JOIN nation ON n_nationkey = district")
def district_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ranked(_district_shares(spark, d).select("name", "metro_pct"), "metro_pct", "name")


def _district_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("name"))
    shares = access.with_shares(access.partition_sums(b.cells(spark, d), BUDGET, ["district"]))
    return relate.complete(n.join(shares.select("district"), "district", "left_semi"), shares, ["district"], ["total", "metro_pct"])


@query(f"WITH {CELLS}, s AS (SELECT district, {_sums(BUDGET_SQL)} FROM cells GROUP BY district), p AS (SELECT n_name, round(100.0::DOUBLE * bus_only / total, 6) AS pct FROM s JOIN nation ON n_nationkey = district) SELECT n_name || ' relies on buses alone the most, with ' || printf('%.1f', pct) || ' percent of its people' AS sentence FROM p ORDER BY pct DESC, n_name LIMIT 1")
def bus_only_leader(spark: SparkSession, d: str) -> DataFrame:
    return ledger.leader(_district_shares(spark, d), "bus_only_pct", "name", "{name} relies on buses alone the most, with {value} percent of its people")


@query("SELECT kind, label, alias FROM (SELECT 'nation' AS kind, n_name AS label, r_name AS alias FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'region', r_name, NULL FROM region) WHERE contains(lower(label), 'ion_1') OR contains(lower(alias), 'ion_1') ORDER BY kind, label, alias LIMIT 12")
def place_search(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places_ = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.col("r_name").alias("alias"))
    return ledger.search(places_.unionByName(r.select(F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("alias"))), " ION_1")


@query("SELECT coalesce(quantile_cont(o_totalprice, 0.98), 1) AS cap FROM orders")
def colour_cap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.colour_cap(table(spark, d, "orders"), "o_totalprice")


@query(f"WITH {ANNUAL}, {CELLS}, s AS (SELECT district, year, round(sum(value), 2) AS total FROM annual JOIN cells USING (cell_id) GROUP BY ALL) SELECT district, year, total FROM s QUALIFY year = max(year) OVER (PARTITION BY district)")
def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """Each district's last year, after its series was found to have no gap."""
    j = b.annual(spark, d).join(b.cells(spark, d).select("cell_id", "district"), "cell_id")
    return ledger.latest(b_written(spark, j.groupBy("district", "year").agg(F.round(F.sum("value"), 2).alias("total"))), ["district"])


@query(f"WITH {ANNUAL} SELECT cell_id, year, before FROM (SELECT cell_id, year, lag(year) OVER (PARTITION BY cell_id ORDER BY year) AS before FROM annual) WHERE year - before <> 1")
def year_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ledger.year_gaps(b.annual(spark, d), ["cell_id"])


@query("""WITH m AS (SELECT l_shipmode_ AS ref, l_returnflag AS name, l_linestatus AS colour, l_partkey AS member, l_quantity AS length FROM (SELECT *, l_suppkey % 9 AS l_shipmode_ FROM lineitem)), o AS (SELECT ref, member, min(length) AS length FROM m GROUP BY ALL),
s AS (SELECT ref, count(*) AS members, sum(length) AS length FROM o GROUP BY ref) SELECT m.ref, min(name) AS label, CASE WHEN count(DISTINCT colour) = 1 THEN min(colour) END AS colour, count(DISTINCT colour) AS colours, any_value(s.members) AS members, round(any_value(s.length), 4) AS length FROM m JOIN s ON s.ref = m.ref GROUP BY m.ref""")
def agreed_lines(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select((F.col("l_suppkey") % 9).alias("ref"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("colour"), F.col("l_partkey").alias("member"), F.col("l_quantity").alias("length"))
    return ledger.agreed_lines(m).withColumn("length", F.round("length", 4))


@query(f"""WITH {CELLS}, t AS (SELECT {BUDGET_SQL} AS budget), s AS (SELECT district, 100.0::DOUBLE * sum(CASE WHEN metro_d <= 50 THEN weight ELSE 0 END) / sum(weight) AS pct, min(metro_d) AS near FROM cells GROUP BY 1)
SELECT district, CASE WHEN pct > 0 THEN NULL WHEN near - 50 <= 25 THEN 'No cell lies within 50 m. The nearest is ' || printf('%.1f', near) || ' m away, ' || printf('%.0f', near - 50) || ' m outside the threshold: sensitive to mapping and walking assumptions.'
ELSE 'No cell lies within 50 m. The nearest is ' || printf('%.1f', near) || ' m away, ' || printf('%.0f', near - 50) || ' m beyond the threshold.' END AS note, CASE WHEN round(pct - 10, 2) = 0 THEN '0.00 pp' ELSE CASE WHEN round(pct - 10, 2) > 0 THEN '+' ELSE '−' END || printf('%.2f', abs(round(pct - 10, 2))) || ' pp' END AS points FROM s""")
def zero_share_notes(spark: SparkSession, d: str) -> DataFrame:
    near = access.within(F.col("metro_d"), 50.0)
    s = b.cells(spark, d).groupBy("district").agg((100.0 * F.sum(F.when(near, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("pct"), F.min("metro_d").alias("near"))
    return s.select("district", ledger.zero_share_note(F.col("pct"), F.col("near"), F.col("near") - 50, 50.0, 25.0).alias("note"), ledger.points_text(F.col("pct") - 10).alias("points"))


@query(f"""WITH {CELLS}, control AS (SELECT c_nationkey AS district, sum(o_totalprice) AS control FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT district, sum(weight) AS a, sum(1 + cell_id % 13) AS b FROM cells JOIN control USING (district) GROUP BY district)
SELECT round(corr(a, b), 6) AS r, round(max(b / a), 6) AS max_ratio, round(min(b / a), 6) AS min_ratio, round(max(b / a) / min(b / a), 6) AS ratio_spread FROM s""")
def district_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Two surfaces' totals by district: correlation and spread of ratios."""
    control = _raw_and_control(spark, d)[1]
    s = b.cells(spark, d).join(control, "district").groupBy("district").agg(F.sum("weight").alias("a"), F.sum(1 + F.col("cell_id") % 13).alias("b"))
    return ledger.spread(s, "a", "b")


@query(f"WITH {CELLS}, a AS (SELECT round(100.0::DOUBLE * sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN weight ELSE 0 END) / sum(weight), 6) AS p FROM cells), z AS (SELECT round(100.0::DOUBLE * count_if(metro_d <= {BUDGET_SQL}) / count(*), 6) AS p FROM cells) SELECT a.p AS current, z.p AS standardised, round(a.p - z.p, 6) AS difference FROM a, z")
def bridge_difference(spark: SparkSession, d: str) -> DataFrame:
    """The city's share by weights and by cells alike, and the difference between the two."""
    cells = b.cells(spark, d)
    pick = lambda c: ledger.exactly_one(access.city_and_groups(c, BUDGET), F.col("scope") == "city")
    return ledger.bridge(pick(cells), pick(cells.withColumn("weight", F.lit(1))), "metro_pct")


@query(f"""WITH {ANNUAL}, {YEARS}, {GRID}, l AS (SELECT *, valid <> lag(valid) OVER (PARTITION BY cell_id ORDER BY year) AS sw FROM grid), n AS (SELECT cell_id, CAST(count_if(sw) AS BIGINT) AS switches FROM l GROUP BY 1) SELECT switches, count(*) AS cells FROM n GROUP BY 1""")
def mask_switches(spark: SparkSession, d: str) -> DataFrame:
    """How often cells become valid or invalid over the years."""
    return temporal.mask_switches(b.grid(spark, d))


# --- checks and composites

CHECKS = ["conservation", "share_is_ratio", "zero_share_beyond_budget", "events_are_changes", "counterfactual", "plausible_ranges", "one_date_a_station", "positions", "exact_copy", "tiling", "monotone_access"]


@query("SELECT c AS \"check\", 0::BIGINT AS violations FROM (VALUES " + ", ".join(f"('{c}')" for c in CHECKS) + ") t(c)")
def more_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The invariants between results; every one must have no violation."""
    cells = b.cells(spark, d)
    shares = b_written(spark, access.with_shares(access.partition_sums(cells, BUDGET, ["district"]), digits=9))
    nearest = cells.groupBy("district").agg(F.min("metro_d").alias("near"))
    stations = b_written(spark, b.stations(spark, d))
    opened = temporal.open_in(stations, b.years(spark, d))
    series = b_written(spark, opened.groupBy("year").agg(F.count("*").cast("int").alias("stations")).withColumn("state_id", F.concat(F.lit("state_"), "stations")))
    first = series.agg(F.min("year")).first()[0]
    # what the network alone would give: the same weights under every state
    fixed = series.withColumn("fixed", (F.col("stations") * 2).cast("double")).withColumn("observed", F.col("fixed") + F.when(F.col("year") == first, 0).otherwise(F.col("year") % 3))
    snap = spatial.snap_to_edges(b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y")), b.edge_lines(spark, d))
    snap = snap.withColumn("distance", F.col("connector_m") + F.col("cost_to_u"))
    tiles = rings(spark, {n: [(a, c), (e, c), (e, g), (a, g)] for n, a, c, e, g in BOXES})
    inner = b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y")).where("abs(x) < 200 AND abs(y) < 200")
    held = spatial.assign_polygon(inner, tiles)
    speeds = access.by_speed(cells).select("district", "scope", "speed_kmh", "metro")
    faster = Window.partitionBy("scope", "district").orderBy("speed_kmh")
    text_copy = shares.select(*[F.col(c).cast(t).alias(c) for c, t in shares.dtypes])
    parts = {
        "conservation": checks.conservation_gap(shares, ["metro", "bus_only", "underserved"], "total"),
        "share_is_ratio": checks.ratio_gap(shares, "metro_pct", "metro", "total"),
        "zero_share_beyond_budget": checks.zero_share_gap(shares.join(nearest, "district"), "metro", "near", BUDGET),
        "events_are_changes": checks.event_gap(temporal.events(series), series),
        "counterfactual": checks.counterfactual_gap(fixed, "observed", "fixed", "state_id", first),
        "plausible_ranges": checks.implausible(shares, {"metro_pct": (0.0, 100.0), "total": (1, 10**9)}),
        "one_date_a_station": checks.unlike_within(stations, ["station_id"], ["opening_year", "name"]),
        "positions": checks.invalid_positions(snap),
        "exact_copy": checks.copied(shares, text_copy, ["district"]),
        "tiling": checks.untiled(inner, held, 400.0 * 400.0, shapes.areas(tiles), inside=0.9),
        "monotone_access": speeds.withColumn("was", F.lag("metro").over(faster)).where("metro < was"),
    }
    return reduce(lambda x, y: x.unionByName(y), [checks.rows_of(name, df) for name, df in parts.items()])


@query(f"""WITH {CELLS}, s AS (SELECT district, sum(weight) AS total, sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN weight ELSE 0 END) AS health, sum(CASE WHEN bus_d <= {BUDGET_SQL} THEN weight ELSE 0 END) AS education, sum(CASE WHEN cell_id % 3 = 0 THEN weight ELSE 0 END) AS bazaar,
 sum(CASE WHEN metro_d <= {BUDGET_SQL} AND bus_d <= {BUDGET_SQL} THEN weight ELSE 0 END) AS joint FROM cells GROUP BY district), f AS (SELECT c_nationkey AS district, {", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)}, count(*) AS "all" FROM customer GROUP BY 1)
SELECT n_nationkey AS district, CAST(total AS BIGINT) AS total, {", ".join(f"round(CASE WHEN total > 0 THEN 100.0::DOUBLE * {k} / total END, 6) AS {k}_pct" for k in ("health", "education", "bazaar", "joint"))}, {", ".join(f"coalesce({s.lower()}, 0) AS {s.lower()}" for s in SEGMENTS)}, coalesce("all", 0) AS "all",
round(CASE WHEN total > 0 THEN 100000.0::DOUBLE * coalesce("all", 0) / total END, 6) AS per_100k, round(coalesce("all", 0) / (1.0::DOUBLE + n_nationkey), 6) AS per_km2 FROM nation LEFT JOIN s ON s.district = n_nationkey LEFT JOIN f ON f.district = n_nationkey""")
def urban_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Three destinations within reach, two at once, supply by category, rates by people and area, for every district."""
    near = lambda c: access.within(F.col(c), BUDGET)
    masks = {"health": near("metro_d"), "education": near("bus_d"), "bazaar": F.col("cell_id") % 3 == 0, "joint": near("metro_d") & near("bus_d")}
    sums = b.cells(spark, d).groupBy("district").agg(F.sum("weight").alias("total"), *[F.sum(F.when(m, F.col("weight")).otherwise(0)).alias(k) for k, m in masks.items()])
    domain = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("category"))
    j = domain.join(sums, "district", "left").join(places.supply(found, domain, SEGMENTS), "district")
    pct = [F.round(access.rate(F.col(k), F.col("total"), 100.0), 6).alias(f"{k}_pct") for k in masks]
    return j.select("district", "total", *pct, *[s.lower() for s in SEGMENTS], "all", F.round(access.rate(F.col("all"), F.col("total"), 100000.0), 6).alias("per_100k"), F.round(F.col("all") / (1.0 + F.col("district")), 6).alias("per_km2"))


@query(f"""WITH {CELLS}, s AS (SELECT district, {_sums(BUDGET_SQL)} FROM cells GROUP BY district), t AS (SELECT *, {PCTS} FROM s), f AS (SELECT c_nationkey AS district, count(*) FILTER (WHERE c_custkey % 5 = 0) AS stops, count(*) FILTER (WHERE c_custkey % 7 = 0) AS bazaars FROM customer GROUP BY 1), w AS (SELECT t.*, stops, bazaars, 1.0::DOUBLE + t.district AS area FROM t JOIN f USING (district))
SELECT district, dimension, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY dimension ORDER BY value DESC, district) AS INTEGER) AS rank FROM (SELECT district, unnest(['population', 'density', 'metro', 'bus', 'busstops', 'bazaars']) AS dimension, unnest([CAST(total AS DOUBLE), total / area, metro_pct, bus_only_pct, stops / area, bazaars * 100000.0::DOUBLE / total]) AS value FROM w)""")
def six_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Districts in six dimensions, each in its own unit and with its own rank."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("district")).agg(F.count_if(F.col("c_custkey") % 5 == 0).alias("stops"), F.count_if(F.col("c_custkey") % 7 == 0).alias("bazaars"))
    w = access.with_shares(access.partition_sums(b.cells(spark, d), BUDGET, ["district"])).join(c, "district").withColumn("area", 1.0 + F.col("district"))
    zero = lambda n, m: F.coalesce(F.try_divide(n, m), F.lit(0.0))
    values = {"population": F.col("total").cast("double"), "density": zero(F.col("total"), F.col("area")), "metro": F.col("metro_pct"), "bus": F.col("bus_only_pct"), "busstops": zero(F.col("stops"), F.col("area")), "bazaars": zero(F.col("bazaars") * 100000.0, F.col("total"))}
    long = w.select("district", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in values.items()])).alias("r")).select("district", "r.*")
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value"), "district"))
    return long.withColumn("rank", rank).withColumn("value", F.round("value", 6))


@query(f"""WITH {CELLS}, {STATIONS}, s AS (SELECT district, {_sums(BUDGET_SQL)} FROM cells GROUP BY district), t AS (SELECT *, {PCTS} FROM s), h AS (SELECT c_nationkey AS district, count(*) AS stations, CAST(min(opening_year) AS INTEGER) AS first_year, string_agg(name, ' | ' ORDER BY opening_year, name) AS opened FROM stations JOIN customer ON c_custkey = station_id GROUP BY 1)
SELECT t.*, coalesce(stations, 0) AS stations, first_year, coalesce(opened, '') AS opened, CAST(row_number() OVER (ORDER BY metro_pct DESC, t.district) AS INTEGER) AS rank FROM t LEFT JOIN h USING (district)""")
def district_profile(spark: SparkSession, d: str) -> DataFrame:
    """A district's access, rank and station history in one row."""
    at = table(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_nationkey").alias("district"))
    h = relate.validated(b.stations(spark, d), at, ["station_id"])
    h = h.groupBy("district").agg(F.count("*").alias("stations"), F.min("opening_year").alias("first_year"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("opening_year", "name"))), lambda x: x["name"]), " | ").alias("opened"))
    t = access.with_shares(access.partition_sums(b.cells(spark, d), BUDGET, ["district"]))
    return ledger.ranked(t.join(h, "district", "left").fillna({"stations": 0, "opened": ""}), "metro_pct", "district")


@query(f"""WITH {STATES}, h AS (SELECT station_id, name, opening_year, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS match_key FROM stations)
SELECT station_id, match_key, opening_year, CAST(row_number() OVER (PARTITION BY opening_year ORDER BY name) AS INTEGER) AS in_batch, count(*) OVER (PARTITION BY opening_year) AS batch FROM h""")
def station_history(spark: SparkSession, d: str) -> DataFrame:
    """Curated openings joined to mapped stations on their match keys, numbered in their batches."""
    s = b_written(spark, b.stations(spark, d))
    curated = s.select(F.upper("name").alias("spelt"), "opening_year")
    mapped = s.select("station_id", "name")
    j = relate.keyed_both_ways(curated, mapped, text.match_key(F.col("spelt")), text.match_key(F.col("name")))
    batch = Window.partitionBy("opening_year")
    return j.select("station_id", "match_key", "opening_year", F.row_number().over(batch.orderBy("name")).alias("in_batch"), F.count("*").over(batch).alias("batch"))


@query("""WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2), 0) AS a, coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2), 0) AS b FROM orders GROUP BY 1)
SELECT year, round(b - a, 2) AS gap FROM s ORDER BY abs(b - a) DESC, year LIMIT 1""")
def widest_gap(spark: SparkSession, d: str) -> DataFrame:
    """The year in which two masks' sums differ most."""
    total = lambda s: F.coalesce(F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2), F.lit(0.0))
    series = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(total("F").alias("a"), total("O").alias("b"))
    return temporal.widest_gap(series, "a", "b").select("year", F.round("gap", 2).alias("gap"))
