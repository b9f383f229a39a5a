"""Registered queries of deduplication and layers; their oracle walks the places one after another in recursive SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netaccess.operators import elements, places, relate
from netaccess.plans import bindings as b
from netaccess.plans.catalogue import query
from netaccess.plans.catalogue_more import GAPS, GAPS_SQL, PTS, box_ring, raw_elements, rings

#: The city: what lies outside is cut away.
CITY = (-200.0, -200.0, 200.0, 200.0)


def gap(a: str, b_: str) -> str:
    return f"sqrt(({a}.x - {b_}.x) * ({a}.x - {b_}.x) + ({a}.y - {b_}.y) * ({a}.y - {b_}.y))"


def walk_sql(name: str, rows: str, order: str, radius: float) -> str:
    """CTEs: ``rows`` (id, x, y, ks) walked in order, each kept unless one kept before shares a key within the radius: <name>(id, kept_id, distance)."""
    return f"""{name}_p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM {rows}),
{name}_w(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(n BIGINT, id BIGINT, x DOUBLE, y DOUBLE, ks VARCHAR[])[]
  UNION ALL SELECT w.n + 1, CASE WHEN len(list_filter(w.kept, lambda k: list_has_any(k.ks, p.ks) AND {gap("k", "p")} <= {radius})) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'n': p.n, 'id': p.id, 'x': p.x, 'y': p.y, 'ks': p.ks}}) END FROM {name}_w w JOIN {name}_p p ON p.n = w.n + 1),
{name}_k AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM {name}_w ORDER BY n DESC LIMIT 1)),
{name} AS (SELECT p.id, coalesce(arg_min(k.id, k.n), p.id) AS kept_id, coalesce(arg_min({gap("k", "p")}, k.n), 0) AS distance FROM {name}_p p
  LEFT JOIN {name}_k ON k.n <= p.n AND (k.id = p.id OR list_has_any(k.ks, p.ks) AND {gap("k", "p")} <= {radius}) GROUP BY p.id)"""


#: The place's district as in attach_district, for a table of (id, x, y).
DISTRICT_SQL = """{name}_j AS (SELECT s.id, g.name, sqrt(greatest(bx1 - x, x - bx2, 0) * greatest(bx1 - x, x - bx2, 0) + greatest(by1 - y, y - by2, 0) * greatest(by1 - y, y - by2, 0)) AS d FROM {rows} s, gaps g),
{name} AS (SELECT id, arg_min(name, (d, name)) AS district, CASE WHEN min(d) = 0 THEN 'within' ELSE 'nearest' END AS method FROM {name}_j GROUP BY id)"""


def named_points(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a place: two name variants, every fifth without any."""
    p = b.points(spark, d)
    return p.select(F.col("vec_id").alias("place_id"), "label", F.col("e1").alias("x"), F.col("e2").alias("y"), (F.col("vec_id") % 3).alias("rank"), variants().alias("keys"))


def variants() -> Column:
    name = F.col("label").cast("string")
    return F.when(F.col("vec_id") % 5 != 0, F.array(name, F.concat(F.lit("v"), F.col("vec_id") % 40), F.lit(""))).otherwise(F.array(F.lit(None).cast("string")))


PLACES = f"""{PTS}, places AS MATERIALIZED (SELECT vec_id AS id, label, e1 AS x, e2 AS y, vec_id % 3 AS rank,
  CASE WHEN vec_id % 5 <> 0 THEN [CAST(label AS VARCHAR), 'v' || vec_id % 40] ELSE []::VARCHAR[] END AS ks FROM pts)"""


@query(f"""WITH RECURSIVE {PLACES}, alike AS (SELECT id, x, y, rank, [CAST(label AS VARCHAR)] AS ks FROM places), {walk_sql("w", "alike", "rank, id", 60)}
SELECT id AS place_id, kept_id, round(distance, 4) AS distance FROM w""")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Places of one label within 60 m of one kept before, by rank and id, go."""
    p = named_points(spark, d)
    return places.greedy_dedupe(p, ["label"], 60.0, ["rank", "place_id"]).withColumn("distance", F.round("distance", 4))


@query(f"WITH RECURSIVE {PLACES}, {walk_sql('w', 'places', 'rank, id', 60)} SELECT id AS place_id, kept_id, round(distance, 4) AS distance FROM w")
def dedupe_by_names(spark: SparkSession, d: str) -> DataFrame:
    """Places that share a name variant with one kept before within 60 m go."""
    return places.dedupe_by_names(named_points(spark, d), 60.0, ["rank", "place_id"]).withColumn("distance", F.round("distance", 4))


INSIDE = "x > -200 AND x < 200 AND y > -200 AND y < 200"


@query(f"""WITH RECURSIVE {PLACES}, {GAPS_SQL}, stops AS MATERIALIZED (SELECT id, x, y, ks, CASE WHEN id % 2 = 0 THEN 'platform' ELSE 'stop_position' END AS role FROM places WHERE {INSIDE}),
paired AS (SELECT id, x, y, role, list_transform(ks, lambda k: k || '/' || role) AS ks FROM stops s WHERE role = 'platform' OR NOT EXISTS (
  SELECT 1 FROM stops o WHERE o.role = 'platform' AND (list_has_any(o.ks, s.ks) AND {gap("s", "o")} <= 50 OR len(s.ks) = 0 AND {gap("s", "o")} <= 25))),
{walk_sql("w", "paired", "id", 5)}, kept AS (SELECT p.* FROM paired p JOIN w ON w.id = p.id AND w.kept_id = w.id), {DISTRICT_SQL.format(name="at_", rows="kept")}
SELECT k.id AS place_id, role, district, method FROM kept k JOIN at_ a ON a.id = k.id""")
def bus_layer(spark: SparkSession, d: str) -> DataFrame:
    """Bus stops by rules A and B: every vector is a platform or a stop position."""
    p = named_points(spark, d).withColumn("role", F.when(F.col("place_id") % 2 == 0, "platform").otherwise("stop_position"))
    return places.bus_layer(p, rings(spark, {n: box_ring(x) for n, x in GAPS.items()}), rings(spark, {"city": box_ring(CITY)})).select("place_id", "role", "district", "method")


@query(f"""WITH RECURSIVE {PLACES}, {GAPS_SQL}, stops AS MATERIALIZED (SELECT id, x, y, ks, rank AS priority, CASE WHEN id % 4 = 0 THEN 'entrance' ELSE 'station' END AS kind FROM places WHERE {INSIDE}),
st AS (SELECT * FROM stops WHERE kind = 'station'), en AS (SELECT id, x, y, kind, ['any'] AS ks FROM stops WHERE kind = 'entrance'),
{walk_sql("w", "st", "priority, id", 200)}, {walk_sql("v", "en", "id", 5)}, kept AS (SELECT s.id, x, y, kind FROM stops s JOIN (SELECT * FROM w UNION ALL SELECT * FROM v) u ON u.id = s.id AND u.kept_id = u.id),
{DISTRICT_SQL.format(name="at_", rows="kept")} SELECT k.id AS place_id, kind, district, method FROM kept k JOIN at_ a ON a.id = k.id""")
def metro_layer(spark: SparkSession, d: str) -> DataFrame:
    """Stations that share a name within 200 m are one, entrances within 5 m: every vector is one or the other."""
    p = named_points(spark, d).withColumn("kind", F.when(F.col("place_id") % 4 == 0, "entrance").otherwise("station")).withColumn("priority", F.col("rank"))
    return places.metro_layer(p, rings(spark, {n: box_ring(x) for n, x in GAPS.items()}), rings(spark, {"city": box_ring(CITY)})).select("place_id", "kind", "district", "method")


@query(f"""WITH RECURSIVE {PTS}, {GAPS_SQL}, el AS (SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, e1, e2,
  CASE WHEN vec_id % 3 = 0 THEN 'point' WHEN vec_id % 3 = 1 AND vec_id % 2 = 0 THEN 'ring' WHEN vec_id % 3 = 1 THEN 'line' WHEN vec_id % 4 <> 0 THEN 'point' END AS kind,
  CASE WHEN vec_id % 5 <> 0 THEN ['place ' || vec_id % 40] ELSE []::VARCHAR[] END AS ks FROM pts),
at0 AS (SELECT id, ks, CASE kind WHEN 'ring' THEN 0 WHEN 'line' THEN 1 ELSE 2 END AS rank, CASE kind WHEN 'ring' THEN e1 + 7.5::DOUBLE WHEN 'line' THEN e1 + 15 ELSE e1 END AS x, CASE kind WHEN 'point' THEN e2 ELSE e2 + 20 END AS y FROM el WHERE kind IS NOT NULL),
inside AS MATERIALIZED (SELECT * FROM at0 WHERE {INSIDE}), {walk_sql("w", "inside", "rank, id", 100)}, kept AS (SELECT p.* FROM inside p JOIN w ON w.id = p.id AND w.kept_id = w.id), {DISTRICT_SQL.format(name="at_", rows="kept")}
SELECT k.id AS place_id, district, method FROM kept k JOIN at_ a ON a.id = k.id""")
def transit_layer(spark: SparkSession, d: str) -> DataFrame:
    """A layer from elements to districts, bazaars for example: boundary, duplicates of a shared name within 100 m, nearest district."""
    from netaccess.functions import text

    e = elements.elements(raw_elements(spark, d), "element")
    name = F.when(elements.tag("name").isNotNull(), F.concat(F.lit("Place "), F.col("id") % 40))
    p = e.select(F.col("id").alias("place_id"), "x", "y", "rank", F.array(text.name_key(name)).alias("keys"))
    gaps, city = rings(spark, {n: box_ring(x) for n, x in GAPS.items()}), rings(spark, {"city": box_ring(CITY)})
    return places.layer(p, gaps, city, places.BAZAAR_RADIUS, ["rank", "place_id"]).select("place_id", "district", "method")


@query(f"""WITH {PLACES} SELECT id FROM places a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM places o WHERE o.id % 2 = 0 AND (list_has_any(a.ks, o.ks) AND {gap("a", "o")} <= 50 OR len(a.ks) = 0 AND {gap("a", "o")} <= 25))""")
def stops_without_platform(spark: SparkSession, d: str) -> DataFrame:
    """Stop positions that no platform stands in for: sharing a name variant within 50 m, or unnamed within 25 m of any."""
    s = named_points(spark, d).withColumnRenamed("place_id", "id")
    return relate.without_near(s.where("id % 2 = 1"), s.where("id % 2 = 0"), places.PAIR_RADIUS, places.PAIR_RADIUS_UNNAMED).select("id")
