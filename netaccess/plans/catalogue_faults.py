"""Checks over results with planted faults: the oracle counts in SQL what breaks each rule, so no count is known beforehand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netaccess.operators import access, checks, spatial, temporal
from netaccess.operators.lineage import cut
from netaccess.plans import bindings as b
from netaccess.plans.bindings import CELLS, NETWORK, SNAP, YEARS
from netaccess.plans.catalogue import BUDGET, BUDGET_SQL, PCTS, _sums, query

FAULTY = f"""sh0 AS (SELECT district, {_sums(BUDGET_SQL)}, min(metro_d) AS near FROM cells GROUP BY district), sh1 AS (SELECT *, {PCTS} FROM sh0),
sh AS (SELECT district, total + CASE WHEN district % 3 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN district % 5 = 0 THEN 0 ELSE metro END AS metro, bus_only, CASE WHEN district % 7 = 0 THEN -underserved ELSE underserved END AS underserved,
  CASE WHEN district % 4 = 0 THEN 100 + metro_pct WHEN district = 6 THEN NULL ELSE metro_pct END AS metro_pct, near FROM sh1),
st AS (SELECT year, 'state_' || (year // 2) AS state_id FROM years), ch AS (SELECT year, state_id FROM (SELECT *, lag(state_id) OVER (ORDER BY year) AS was FROM st) WHERE was <> state_id),
ev AS (SELECT year + CASE WHEN year % 4 = 0 THEN 1 ELSE 0 END AS year, state_id FROM ch),
po AS (SELECT CASE WHEN vec_id % 6 = 0 THEN connector_m / 2 ELSE connector_m + f * cost_m END AS distance, connector_m, CASE WHEN vec_id % 10 = 0 THEN f + 1 WHEN vec_id % 15 = 1 THEN NULL ELSE f END AS fraction FROM snap WHERE kind = 'cell')"""


@query(f"""WITH {CELLS}, {YEARS}, {NETWORK}, {SNAP}, {FAULTY}
SELECT 'conservation' AS "check", CAST(count_if(abs(metro + bus_only + underserved - total) > 1e-3 OR metro < 0 OR bus_only < 0 OR underserved < 0 OR metro > total + 1e-3 OR bus_only > total + 1e-3 OR underserved > total + 1e-3) AS BIGINT) AS violations FROM sh
UNION ALL SELECT 'share_is_ratio', CAST(count_if(metro_pct IS NULL OR abs(metro_pct - 100.0::DOUBLE * metro / total) > 1e-5) AS BIGINT) FROM sh
UNION ALL SELECT 'zero_share', CAST(count_if((metro = 0) <> (near > {BUDGET_SQL})) AS BIGINT) FROM sh
UNION ALL SELECT 'plausible', CAST(count(*) AS BIGINT) FROM (SELECT count_if(metro_pct IS NULL OR metro_pct NOT BETWEEN 0 AND 100) AS n FROM sh UNION ALL SELECT count_if(underserved NOT BETWEEN 0 AND 1e9) FROM sh UNION ALL SELECT count_if(total NOT BETWEEN 1 AND 1e9) FROM sh) WHERE n > 0
UNION ALL SELECT 'duplicates', CAST(count(*) AS BIGINT) FROM (SELECT cell_id FROM (SELECT cell_id FROM cells UNION ALL SELECT cell_id FROM cells WHERE cell_id % 9 = 0) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM ev FULL JOIN ch ON ev.year = ch.year WHERE ev.state_id IS DISTINCT FROM ch.state_id
UNION ALL SELECT 'positions', CAST(count_if(connector_m > distance OR fraction IS NULL OR fraction < 0 OR fraction > 1) AS BIGINT) FROM po
UNION ALL SELECT 'missing_keys', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT district FROM cells) x CROSS JOIN years y WHERE (x.district + y.year) % 11 = 0
UNION ALL SELECT 'copies', CAST(sum(CASE WHEN metro % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN district % 8 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM sh1""")
def planted_faults(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule is broken by results with faults planted in them."""
    cells = b.cells(spark, d)
    near = cells.groupBy("district").agg(F.min("metro_d").alias("near"))
    clean = cut(access.with_shares(access.partition_sums(cells, BUDGET, ["district"])).join(near, "district"))
    k = F.col("district")
    bad = clean.select(
        "district", (F.col("total") + F.when(k % 3 == 0, 1).otherwise(0)).alias("total"), F.when(k % 5 == 0, 0).otherwise(F.col("metro")).alias("metro"), "bus_only",
        F.when(k % 7 == 0, -F.col("underserved")).otherwise(F.col("underserved")).alias("underserved"), F.when(k % 4 == 0, 100 + F.col("metro_pct")).when(k == 6, None).otherwise(F.col("metro_pct")).alias("metro_pct"), "near",
    )
    states = cut(b.years(spark, d).select("year", F.concat(F.lit("state_"), F.floor(F.col("year") / 2).cast("string")).alias("state_id")))
    changes = states.withColumn("was", F.lag("state_id").over(Window.orderBy("year"))).where("was <> state_id")  # a row for each year
    events = changes.select((F.col("year") + F.when(F.col("year") % 4 == 0, 1).otherwise(0)).alias("year"), "state_id")
    snap = spatial.snap_to_edges(b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("e3").alias("x"), F.col("e4").alias("y")), b.edge_lines(spark, d))
    v = F.col("point_id")
    moved = snap.select(
        F.when(v % 6 == 0, F.col("connector_m") / 2).otherwise(F.col("connector_m") + F.col("cost_to_u")).alias("distance"), "connector_m",
        F.when(v % 10 == 0, F.col("fraction") + 1).when(v % 15 == 1, None).otherwise(F.col("fraction")).alias("fraction"),
    )
    grid = cells.select("district").distinct().crossJoin(F.broadcast(b.years(spark, d))).where((F.col("district") + F.col("year")) % 11 != 0)  # a handful of years
    other = clean.withColumn("metro", F.when(F.col("metro") % 3 == 0, F.col("metro") + 1).otherwise(F.col("metro"))).withColumn("near", F.when(k % 8 == 0, F.col("near") + 1).otherwise(F.col("near")))
    parts = {
        "conservation": checks.conservation_gap(bad, ["metro", "bus_only", "underserved"], "total"),
        "share_is_ratio": checks.ratio_gap(bad, "metro_pct", "metro", "total", 1e-5),
        "zero_share": checks.zero_share_gap(bad, "metro", "near", BUDGET),
        "plausible": checks.implausible(bad, {"metro_pct": (0.0, 100.0), "underserved": (0, 10**9), "total": (1, 10**9)}),
        "duplicates": checks.duplicates(cells.unionByName(cells.where("cell_id % 9 = 0")), ["cell_id"]),
        "events": checks.event_gap(events, states),
        "positions": checks.invalid_positions(moved),
        "missing_keys": checks.missing_keys(grid, district=cells, year=b.years(spark, d)),
        "copies": checks.copied(clean, other, ["district"]),
    }
    return reduce(lambda x, y: x.unionByName(y), [checks.rows_of(name, df) for name, df in parts.items()])


@query(f"""WITH {YEARS}, s AS (SELECT c_custkey AS station_id, CAST(min(year(o_orderdate)) AS INTEGER) AS opened, CAST(max(year(o_orderdate)) AS INTEGER) AS closed FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
o AS (SELECT y.year, station_id FROM s JOIN years y ON y.year >= opened AND y.year <= closed), g AS (SELECT year, list(station_id ORDER BY station_id) AS ids FROM o GROUP BY 1),
l AS (SELECT year, ids, lag(ids) OVER (ORDER BY year) AS before FROM g)
SELECT year, CAST(len(ids) AS INTEGER) AS stations, CAST(len(list_filter(before, lambda i: NOT list_contains(ids, i))) AS INTEGER) AS lost FROM l WHERE len(list_filter(before, lambda i: NOT list_contains(ids, i))) > 0""")
def lost_stations(spark: SparkSession, d: str) -> DataFrame:
    """Years whose open stations lack some of the year before: stations that close break the nesting of states."""
    orders = b.table(spark, d, "orders")
    s = orders.groupBy(F.col("o_custkey").alias("station_id")).agg(F.min(F.year("o_orderdate")).alias("opening_year"), F.max(F.year("o_orderdate")).alias("closed"))
    opened = temporal.open_in(s.select("station_id", "opening_year"), b.years(spark, d)).join(s.select("station_id", "closed"), "station_id").where("year <= closed").select("year", "station_id")
    return temporal.lost_between_years(opened)
