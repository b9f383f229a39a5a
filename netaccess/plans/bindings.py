"""The driver's tables as cells, stations, networks and surfaces; the same algebra in Spark and, as CTEs, in DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netaccess.operators import network, spatial
from netaccess.operators.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells without geometry: district, weight and two distances."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("cell_id"), F.col("c_nationkey").alias("district"), (1 + key % 97).alias("weight"),
        (F.abs("c_acctbal") / 5).alias("metro_d"), ((key * 37) % 2000).cast("double").alias("bus_d"),
    )


CELLS = """cells AS (
  SELECT c_custkey AS cell_id, c_nationkey AS district, 1 + c_custkey % 97 AS weight, abs(c_acctbal) / 5 AS metro_d,
         CAST((c_custkey * 37) % 2000 AS DOUBLE) AS bus_d FROM customer)"""


def stations(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("opening_year"))
    picked = table(spark, d, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("name"))
    return picked.join(first, picked.station_id == first.o_custkey).select("station_id", "name", "opening_year")


STATIONS = """stations AS (
  SELECT c_custkey AS station_id, c_name AS name, CAST(year(min(o_orderdate)) AS INTEGER) AS opening_year
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


YEARS = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"


def annual(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, year, value): sums of orders; no row is no data, not zero."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))


ANNUAL = "annual AS (SELECT o_custkey AS cell_id, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """annual made dense: every customer that ever ordered, every year, valid or not."""
    a = annual(spark, d)
    each = a.select("cell_id").distinct().crossJoin(F.broadcast(years(spark, d)))  # a handful of years
    return each.join(a, ["cell_id", "year"], "left").withColumn("valid", F.col("value").isNotNull())


GRID = """grid AS (
  SELECT k.cell_id, y.year, a.value, a.value IS NOT NULL AS valid
  FROM (SELECT DISTINCT cell_id FROM annual) k CROSS JOIN years y LEFT JOIN annual a ON a.cell_id = k.cell_id AND a.year = y.year)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double") * 1000
    return table(spark, d, "embeddings").select("vec_id", "label", *[e(i).alias(f"e{i + 1}") for i in range(6)])


def edge_records(spark: SparkSession, d: str) -> DataFrame:
    """Each vector to the next of its label, and every third to the seventh after it."""
    p = points(spark, d).select("vec_id", "label", "e1", "e2")
    chain = p.select(F.col("vec_id").alias("u"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("v")).where("v IS NOT NULL")
    jump = p.where("vec_id % 3 = 0").select(F.col("vec_id").alias("u"), (F.col("vec_id") + 7).alias("v"))
    a, b = p.select(F.col("vec_id").alias("u"), F.col("e1").alias("x1"), F.col("e2").alias("y1")), p.select(F.col("vec_id").alias("v"), F.col("e1").alias("x2"), F.col("e2").alias("y2"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return chain.unionByName(jump).join(a, "u").join(b, "v").select("u", "v", F.sqrt(dx * dx + dy * dy).alias("cost"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return network.canonical_edges(edge_records(spark, d))


def edge_lines(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    p = points(spark, d)
    a, b = p.select(F.col("vec_id").alias("u"), F.col("e1").alias("x1"), F.col("e2").alias("y1")), p.select(F.col("vec_id").alias("v"), F.col("e1").alias("x2"), F.col("e2").alias("y2"))
    return (edges(spark, d) if e is None else e).join(a, "u").join(b, "v").select("edge_id", "u", "v", "cost_m", "x1", "y1", "x2", "y2")


NETWORK = """pts AS (
  SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS e1, CAST(embedding[2] AS DOUBLE) * 1000 AS e2, CAST(embedding[3] AS DOUBLE) * 1000 AS e3,
         CAST(embedding[4] AS DOUBLE) * 1000 AS e4, CAST(embedding[5] AS DOUBLE) * 1000 AS e5, CAST(embedding[6] AS DOUBLE) * 1000 AS e6 FROM embeddings
), rec AS (
  SELECT vec_id AS u, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS v FROM pts
  UNION ALL SELECT vec_id, vec_id + 7 FROM pts WHERE vec_id % 3 = 0
), raw AS (
  SELECT least(u, v) AS u, greatest(u, v) AS v, sqrt((p.e1 - q.e1) * (p.e1 - q.e1) + (p.e2 - q.e2) * (p.e2 - q.e2)) AS cost
  FROM rec JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v
), edges AS (
  SELECT row_number() OVER (ORDER BY u, v, round(cost, 6)) - 1 AS edge_id, u, v, min(cost) AS cost_m, count(*) AS records
  FROM raw WHERE cost > 0 GROUP BY u, v, round(cost, 6)
)"""

SNAP = """lines AS (
  SELECT e.*, p.e1 AS x1, p.e2 AS y1, q.e1 AS x2, q.e2 AS y2 FROM edges e JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v
), spots AS (
  SELECT 'cell' AS kind, vec_id, e3 AS x, e4 AS y FROM pts
  UNION ALL SELECT 'metro', vec_id, e5, e6 FROM pts WHERE vec_id % 50 = 0
  UNION ALL SELECT 'bus', vec_id, e5, e6 FROM pts WHERE vec_id % 11 = 3
), proj AS (
  SELECT kind, s.vec_id, x, y, edge_id, u, v, cost_m, x1, y1, x2, y2,
         greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS f
  FROM spots s CROSS JOIN lines
), dist AS (
  SELECT *, sqrt((x - x1 - f * (x2 - x1)) * (x - x1 - f * (x2 - x1)) + (y - y1 - f * (y2 - y1)) * (y - y1 - f * (y2 - y1))) AS connector_m FROM proj
), snap AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY kind, vec_id ORDER BY connector_m, edge_id) = 1)"""

#: Distances over nodes by relaxation from both ends of each source's edge; no splicing, so a different way to the same numbers.
ROUTES = """adj AS (
  SELECT u AS a, v AS b, min(cost_m) AS w FROM edges WHERE u <> v GROUP BY ALL UNION ALL SELECT v, u, min(cost_m) FROM edges WHERE u <> v GROUP BY ALL
), seeds AS (
  SELECT kind AS mode, u AS node, connector_m + f * cost_m AS d FROM snap WHERE kind <> 'cell'
  UNION ALL SELECT kind, v, connector_m + (1 - f) * cost_m FROM snap WHERE kind <> 'cell'
), reach(mode, node, d) USING KEY (mode, node) AS (
  SELECT mode, node, min(d) FROM seeds GROUP BY ALL
  UNION
  SELECT n.mode, n.node, n.d FROM (
    SELECT r.mode, a.b AS node, min(r.d + a.w) AS d FROM reach r JOIN adj a ON a.a = r.node GROUP BY ALL) n
  LEFT JOIN recurring.reach o ON o.mode = n.mode AND o.node = n.node WHERE o.d IS NULL OR n.d < o.d
), cell_d AS (
  SELECT m.mode, c.vec_id, c.connector_m + least(coalesce(du.d, 'inf'::DOUBLE) + c.f * c.cost_m, coalesce(dv.d, 'inf'::DOUBLE) + (1 - c.f) * c.cost_m,
         coalesce((SELECT min(s.connector_m + abs(c.f - s.f) * c.cost_m) FROM snap s WHERE s.kind = m.mode AND s.edge_id = c.edge_id), 'inf'::DOUBLE)) AS distance
  FROM snap c CROSS JOIN (VALUES ('metro'), ('bus')) m(mode)
  LEFT JOIN reach du ON du.mode = m.mode AND du.node = c.u LEFT JOIN reach dv ON dv.mode = m.mode AND dv.node = c.v WHERE c.kind = 'cell'
)"""

MODES = ["metro", "bus"]


class Routed:
    """The routed network of the embeddings; each part is computed when it is first asked for, once for a query.

    Parts are written tables: what is computed once survives the loss of an executor.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.points = points(spark, d)
        self.spark, self.dir = spark, d

    @cached_property
    def edges(self) -> DataFrame:
        return cut(edges(self.spark, self.dir))

    @cached_property
    def lines(self) -> DataFrame:
        return cut(edge_lines(self.spark, self.dir, self.edges))

    @cached_property
    def snap(self) -> DataFrame:
        spot = lambda k, x, y, where: self.points.where(where).select(F.concat(F.lit(k + ":"), "vec_id").alias("point_id"), F.col(x).alias("x"), F.col(y).alias("y"))
        spots = spot("cell", "e3", "e4", "true").unionByName(spot("metro", "e5", "e6", "vec_id % 50 = 0")).unionByName(spot("bus", "e5", "e6", "vec_id % 11 = 3"))
        found = spatial.snap_to_edges(spots, self.lines)
        return found.withColumn("kind", F.substring_index("point_id", ":", 1)).withColumn("vec_id", F.substring_index("point_id", ":", -1).cast("long"))

    @cached_property
    def spliced(self) -> DataFrame:
        return cut(network.splice(self.edges, self.snap.where("kind <> 'cell'").withColumn("mode", F.col("kind"))))

    @cached_property
    def segments(self) -> DataFrame:
        return cut(network.segments(network.break_table(self.edges, self.spliced, MODES), self.edges))

    @cached_property
    def reached(self) -> DataFrame:
        entries = self.spliced.where("connector_m IS NOT NULL").select("mode", "node", F.col("connector_m").alias("cost"))
        return cut(network.multi_source_distances(network.adjacency(self.segments), entries))

    def cells(self) -> DataFrame:
        own = self.snap.where("kind = 'cell'").select(F.col("vec_id").alias("point_id"), "edge_id", "fraction", "connector_m")
        return network.cell_distances(own, self.segments, self.reached)
