"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netaccess.functions import text
from netaccess.operators import access, checks, network, places, spatial, surface, temporal, weights
from netaccess.plans import bindings as b
from netaccess.plans.bindings import ANNUAL, CELLS, GRID, NETWORK, ROUTES, SNAP, STATIONS, YEARS, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BUDGET = access.budget_m(4.8)
BUDGET_SQL = "(4.8::DOUBLE * 1000 / 3600 * 600)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sums(budget: str, w: str = "weight") -> str:
    return f"""CAST(sum({w}) AS BIGINT) AS total, CAST(sum(CASE WHEN metro_d <= {budget} THEN {w} ELSE 0 END) AS BIGINT) AS metro,
  CAST(sum(CASE WHEN NOT metro_d <= {budget} AND bus_d <= {budget} THEN {w} ELSE 0 END) AS BIGINT) AS bus_only,
  CAST(sum(CASE WHEN NOT metro_d <= {budget} AND NOT bus_d <= {budget} THEN {w} ELSE 0 END) AS BIGINT) AS underserved"""


PCTS = ", ".join(f"round(coalesce(100.0::DOUBLE * {p} / nullif(total, 0), 0), 6) AS {p}_pct" for p in ("metro", "bus_only", "underserved"))


@query(f"WITH {CELLS}, s AS (SELECT district, {_sums(BUDGET_SQL)} FROM cells GROUP BY district) SELECT *, {PCTS} FROM s")
def access_partition(spark: SparkSession, d: str) -> DataFrame:
    return access.with_shares(access.partition_sums(b.cells(spark, d), BUDGET, ["district"]))


@query(f"WITH {CELLS}, s AS (SELECT district, CASE WHEN grouping(district) = 0 THEN 'district' ELSE 'city' END AS scope, {_sums(BUDGET_SQL)} FROM cells GROUP BY GROUPING SETS ((district), ())) SELECT *, {PCTS} FROM s")
def access_city_and_district(spark: SparkSession, d: str) -> DataFrame:
    return access.city_and_groups(b.cells(spark, d), BUDGET)


@query(f"""WITH {CELLS}, v AS (SELECT speed AS speed_kmh, speed * 1000 / 3600 * 600 AS budget FROM (VALUES (4.0::DOUBLE), (4.8::DOUBLE), (5.6::DOUBLE)) t(speed)),
s AS (SELECT speed_kmh, budget, district, CASE WHEN grouping(district) = 0 THEN 'district' ELSE 'city' END AS scope, {_sums('budget')} FROM cells CROSS JOIN v GROUP BY GROUPING SETS ((speed_kmh, budget, district), (speed_kmh, budget)))
SELECT * EXCLUDE (budget), round(budget, 4) AS budget_m, {PCTS} FROM s""")
def speed_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return access.by_speed(b.cells(spark, d))


def _raw_and_control(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_partkey") % 10).alias("bucket"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("district"))
    oc = o.join(c, o.o_custkey == c.c_custkey)
    raw = li.join(oc, li.l_orderkey == oc.o_orderkey).groupBy("district", "bucket").agg(F.sum("l_quantity").alias("raw"))
    return raw, oc.groupBy("district").agg(F.sum("o_totalprice").alias("control"))


CALIBRATED = """raw AS (SELECT c_nationkey AS district, l_partkey % 10 AS bucket, sum(l_quantity) AS raw FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
control AS (SELECT c_nationkey AS district, sum(o_totalprice) AS control FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cal AS (SELECT r.*, control / sum(raw) OVER (PARTITION BY r.district) AS factor FROM raw r JOIN control c ON c.district = r.district)"""


@query(f"WITH {CALIBRATED} SELECT district, bucket, round(raw, 4) AS raw, round(factor, 6) AS factor, round(raw * factor, 2) AS calibrated FROM cal")
def calibrate_to_control(spark: SparkSession, d: str) -> DataFrame:
    raw, control = _raw_and_control(spark, d)
    got = weights.calibrate(raw, control, ["district"])
    return got.select("district", "bucket", F.round("raw", 4).alias("raw"), F.round("factor", 6).alias("factor"), F.round("calibrated", 2).alias("calibrated"))


@query(f"""WITH {CELLS}, control AS (SELECT c_nationkey AS district, sum(o_totalprice) AS control FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
two AS (SELECT c.*, weight * control / sum(weight) OVER (PARTITION BY c.district) AS w1, (1 + cell_id % 13) * control / sum(1 + cell_id % 13) OVER (PARTITION BY c.district) AS w2 FROM cells c JOIN control k ON k.district = c.district),
s AS (SELECT district, 100 * sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN w1 ELSE 0 END) / sum(w1) AS a, 100 * sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN w2 ELSE 0 END) / sum(w2) AS b FROM two GROUP BY district)
SELECT district, round(a, 4) AS metro_pct_a, round(b, 4) AS metro_pct_b, round(b - a, 4) AS difference_pp FROM s""")
def surface_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Two weight surfaces calibrated to the same totals: how much the metro share depends on the surface."""
    cells = b.cells(spark, d)
    control = _raw_and_control(spark, d)[1]
    sums = cells.groupBy("district").agg(F.sum("weight").alias("sa"), F.sum(1 + F.col("cell_id") % 13).alias("sb")).join(control, "district")
    j = cells.join(sums, "district")
    wa, wb = F.col("weight") * F.col("control") / F.col("sa"), (1 + F.col("cell_id") % 13) * F.col("control") / F.col("sb")
    near = access.within(F.col("metro_d"), BUDGET)
    got = j.groupBy("district").agg(*[(100 * F.sum(F.when(near, w).otherwise(0.0)) / F.sum(w)).alias(k) for k, w in (("a", wa), ("b", wb))])
    return got.select("district", F.round("a", 4).alias("metro_pct_a"), F.round("b", 4).alias("metro_pct_b"), F.round(F.col("b") - F.col("a"), 4).alias("difference_pp"))


@query(f"""WITH {CELLS}, w AS (SELECT *, CASE WHEN cell_id % 7 = 0 THEN NULL WHEN cell_id % 11 = 0 THEN 'nan'::DOUBLE ELSE weight::DOUBLE END AS w FROM cells),
s AS (SELECT district, sum(w) FILTER (WHERE NOT isnan(w)) AS denominator, sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN w ELSE 0 END) FILTER (WHERE NOT isnan(w)) AS numerator FROM w GROUP BY district)
SELECT *, round(CASE WHEN denominator > 0 THEN 100 * numerator / denominator END, 6) AS pct FROM s""")
def weighted_access_missing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cell_id")
    w = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("weight").cast("double"))
    return access.weighted_access(b.cells(spark, d), w, access.within(F.col("metro_d"), BUDGET), ["district"])


@query(f"""WITH {CELLS}, s AS (SELECT district, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(CASE WHEN cell_id % 3 = 0 THEN weight ELSE 0 END) AS BIGINT) AS covered,
{", ".join(f"CAST(sum(CASE WHEN cell_id % 3 = 0 AND {c} THEN weight ELSE 0 END) AS BIGINT) AS {n}_covered" for n, c in (("metro", f"metro_d <= {BUDGET_SQL}"), ("bus_only", f"NOT metro_d <= {BUDGET_SQL} AND bus_d <= {BUDGET_SQL}"), ("underserved", f"NOT metro_d <= {BUDGET_SQL} AND NOT bus_d <= {BUDGET_SQL}")))}
FROM cells GROUP BY district) SELECT *, {", ".join(f"round(coalesce(100.0::DOUBLE * {n}_covered / nullif(total, 0), 0), 6) AS {n}_covered_pct" for n in ("metro", "bus_only", "underserved"))} FROM s""")
def overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    return access.overlaps(b.cells(spark, d), BUDGET, F.col("cell_id") % 3 == 0, ["district"])


@query(f"WITH {STATIONS}, y AS (SELECT opening_year, count(*) AS opened, string_agg(name, ' | ' ORDER BY name) AS names FROM stations GROUP BY ALL) SELECT *, CAST(sum(opened) OVER (ORDER BY opening_year) AS BIGINT) AS cumulative FROM y")
def opening_timeline(spark: SparkSession, d: str) -> DataFrame:
    return temporal.opening_timeline(b.stations(spark, d))


@query(f"WITH {STATIONS}, {YEARS} SELECT year, station_id FROM years JOIN stations ON opening_year <= year")
def open_by_year(spark: SparkSession, d: str) -> DataFrame:
    return temporal.open_in(b.stations(spark, d), b.years(spark, d))


STATES = f"""{STATIONS}, {YEARS}, sets AS (SELECT year, list(station_id ORDER BY station_id) AS ids FROM years JOIN stations ON opening_year <= year GROUP BY year),
states AS (SELECT 'state_' || len(ids) AS state_id, ids, list(year ORDER BY year) AS years FROM sets GROUP BY ids)"""


@query(f"WITH {STATES} SELECT state_id, CAST(len(ids) AS INTEGER) AS stations, array_to_string(ids, ',') AS ids, array_to_string(years, ',') AS years, sha256(array_to_string(ids, chr(10)) || chr(10)) AS digest FROM states")
def source_states(spark: SparkSession, d: str) -> DataFrame:
    s = temporal.source_states(temporal.open_in(b.stations(spark, d), b.years(spark, d)))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return s.select("state_id", "stations", join("ids"), join("years"), "digest")


@query(f"""WITH {ANNUAL}, {CELLS}, s AS (SELECT district, year, round(sum(value), 2) AS total, round(sum(CASE WHEN metro_d <= {BUDGET_SQL} THEN value ELSE 0 END), 2) AS metro FROM annual JOIN cells USING (cell_id) GROUP BY ALL),
p AS (SELECT *, round(100 * metro / nullif(total, 0), 6) AS pct FROM s)
SELECT *, round(pct - first_value(pct) OVER w, 6) AS change, round(100 * (pct - first_value(pct) OVER w) / nullif(first_value(pct) OVER w, 0), 6) AS growth_pct FROM p WINDOW w AS (PARTITION BY district ORDER BY year)""")
def annual_series(spark: SparkSession, d: str) -> DataFrame:
    """Shares by district and year from rounded sums, with the change from each district's first year."""
    j = b.annual(spark, d).join(b.cells(spark, d).drop("weight"), "cell_id")
    near = access.within(F.col("metro_d"), BUDGET)
    s = j.groupBy("district", "year").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.sum(F.when(near, F.col("value")).otherwise(0.0)), 2).alias("metro"))
    s = s.withColumn("pct", F.round(F.try_divide(100 * F.col("metro"), "total"), 6))
    return temporal.change_from_base(s, ["district"], "pct")


@query(f"""WITH {STATES}, y AS (SELECT year, 'state_' || len(ids) AS state_id, CAST(len(ids) AS INTEGER) AS stations FROM sets)
SELECT year, state_id, stations, prev AS previous_state, CAST(stations - before AS INTEGER) AS added FROM (SELECT *, lag(state_id) OVER (ORDER BY year) AS prev, lag(stations) OVER (ORDER BY year) AS before FROM y) WHERE prev <> state_id""")
def expansion_events(spark: SparkSession, d: str) -> DataFrame:
    opened = temporal.open_in(b.stations(spark, d), b.years(spark, d))
    y = opened.groupBy("year").agg(F.count("*").cast("int").alias("stations")).withColumn("state_id", F.concat(F.lit("state_"), "stations"))
    y = y.withColumn("added", (F.col("stations") - F.lag("stations").over(Window.orderBy("year"))).cast("int"))
    return temporal.events(y).select("year", "state_id", "stations", "previous_state", "added")


@query(f"""WITH {STATES}, {CELLS}, {ANNUAL}, near AS (SELECT DISTINCT s.year AS state_year, c.cell_id FROM (SELECT year, unnest(ids) AS station_id FROM sets) s JOIN cells c ON c.cell_id % 1000 BETWEEN s.station_id % 1000 - 2 AND s.station_id % 1000 + 2),
base AS (SELECT min(year) AS y0 FROM years),
w AS (SELECT a.cell_id, a.year, a.value FROM annual a JOIN cells USING (cell_id)),
tot AS (SELECT year, sum(value) AS total FROM w GROUP BY year),
x AS (SELECT y.year, sum(w.value) FILTER (WHERE w.year = y.year AND n.state_year = y.year) AS observed, sum(w.value) FILTER (WHERE w.year = y0 AND n.state_year = y.year) AS net, sum(w.value) FILTER (WHERE w.year = y.year AND n.state_year = y0) AS pop
  FROM years y CROSS JOIN base JOIN near n ON n.state_year IN (y.year, y0) JOIN w ON w.cell_id = n.cell_id AND w.year IN (y.year, y0) AND NOT (n.state_year = y0 AND w.year = y0 AND y.year <> y0) GROUP BY ALL)
SELECT x.year, round(100 * observed / t.total, 4) AS observed_pct, round(100 * net / t0.total, 4) AS network_only_pct, round(100 * pop / t.total, 4) AS weights_only_pct
FROM x JOIN tot t ON t.year = x.year CROSS JOIN base JOIN tot t0 ON t0.year = y0""")
def counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """Observed shares against states on first-year weights, and first-year state on each year's weights."""
    opened = temporal.open_in(b.stations(spark, d), b.years(spark, d))
    cells = b.cells(spark, d).select("cell_id")
    # a cell is near a station when their numbers within a thousand are: an equi join on the five neighbours
    reach = opened.select(F.col("year").alias("state_year"), F.explode(F.sequence(F.col("station_id") % 1000 - 2, F.col("station_id") % 1000 + 2)).alias("m"))
    near = cells.withColumn("m", F.col("cell_id") % 1000).join(reach.distinct(), "m").select("state_year", "cell_id").distinct()
    w = b.annual(spark, d).join(cells, "cell_id")
    y0 = b.years(spark, d).agg(F.min("year").alias("y0"))
    total = w.groupBy("year").agg(F.sum("value").alias("total"))
    cross = near.join(w, "cell_id").groupBy("state_year", "year").agg(F.sum("value").alias("v")).crossJoin(F.broadcast(y0))
    pick = lambda year, cond, name: cross.where(cond).select(F.col(year).alias("year"), F.col("v").alias(name))
    out = pick("year", "state_year = year", "both").join(pick("state_year", "year = y0", "net"), "year").join(pick("year", "state_year = y0", "pop"), "year")
    first = total.join(F.broadcast(y0), F.col("year") == F.col("y0")).select(F.col("total").alias("t0"))
    out = out.join(total, "year").crossJoin(F.broadcast(first))
    r = lambda a, t, n: F.round(100 * F.col(a) / F.col(t), 4).alias(n)
    return out.select("year", r("both", "total", "observed_pct"), r("net", "t0", "network_only_pct"), r("pop", "total", "weights_only_pct"))


@query(f"""WITH {ANNUAL}, {YEARS}, {GRID}, l AS (SELECT *, lag(valid) OVER (PARTITION BY cell_id ORDER BY year) AS before FROM grid)
SELECT year, CAST(count_if(valid) AS BIGINT) AS valid, CAST(count_if(valid AND NOT before) AS BIGINT) AS up, CAST(count_if(NOT valid AND before) AS BIGINT) AS down FROM l GROUP BY year""")
def mask_transitions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.mask_transitions(b.grid(spark, d))


@query(f"""WITH {ANNUAL}, {YEARS}, {GRID}, p AS (SELECT cell_id, bool_and(valid) AS alls, sum(value) FILTER (WHERE year = 1996) AS v0, sum(value) FILTER (WHERE year = 2000) AS v1 FROM grid GROUP BY cell_id),
s AS (SELECT sum(v0) AS a0, sum(v1) AS a1, sum(v0) FILTER (WHERE alls) AS b0, sum(v1) FILTER (WHERE alls) AS b1, CAST(count_if(alls) AS BIGINT) AS common_cells FROM p)
SELECT round(100 * (a1 - a0) / a0, 6) AS growth_a, round(100 * (b1 - b0) / nullif(b0, 0), 6) AS growth_b, common_cells FROM s""")
def method_a_vs_b_growth(spark: SparkSession, d: str) -> DataFrame:
    return temporal.union_and_common_growth(b.grid(spark, d), 1996, 2000)


@query(f"""WITH {ANNUAL}, a AS (SELECT cell_id, value AS a FROM annual WHERE year = 1996), bb AS (SELECT cell_id, value AS b FROM annual WHERE year = 1997),
j AS (SELECT a, b FROM a FULL JOIN bb USING (cell_id)), m AS (SELECT a, b, b / a AS ratio FROM j WHERE a IS NOT NULL AND b IS NOT NULL),
o AS (SELECT sum(a * b) / sum(a * a) AS k, corr(a, b) AS r, sum(b) / sum(a) AS total_ratio, quantile_cont(ratio, [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]) AS q FROM m),
t AS (SELECT avg(abs(b - k * a)) AS mae, quantile_cont(abs(b - k * a), 0.5) AS median_residual, max(abs(b - k * a)) AS max_residual, sqrt(avg((b - k * a) * (b - k * a))) / avg(b) AS nrmse, sum(abs(b - k * a)) / sum(b) AS relative_l1,
  avg(CASE WHEN abs(ratio - q[4]) <= 0.1::DOUBLE * q[4] THEN 1.0::DOUBLE ELSE 0 END) AS near_median FROM m, o)
SELECT (SELECT count(*) FROM m) AS common, (SELECT count(*) FROM j WHERE b IS NULL) AS only_a, (SELECT count(*) FROM j WHERE a IS NULL) AS only_b,
{", ".join(f"round({c}, 6) AS {c}" for c in ("r", "k", "total_ratio", "mae", "median_residual", "max_residual", "nrmse", "relative_l1", "near_median"))},
{", ".join(f"round(q[{i + 1}], 6) AS ratio_p{p}" for i, p in enumerate((0, 1, 5, 50, 95, 99, 100)))} FROM o, t""")
def surface_compare(spark: SparkSession, d: str) -> DataFrame:
    a = b.annual(spark, d)
    return surface.compare(a.where("year = 1996"), a.where("year = 1997"), "cell_id")


@query("""WITH v AS (SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 50 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS x FROM orders)
SELECT priority, count(x) FILTER (WHERE x < 'inf') AS finite, CAST(count_if(x = 'inf') AS BIGINT) AS infinite, round(min(x) FILTER (WHERE x < 'inf'), 4) AS min, round(avg(x) FILTER (WHERE x < 'inf'), 4) AS mean,
round(quantile_cont(x, 0.5) FILTER (WHERE x < 'inf'), 4) AS median, round(quantile_cont(x, 0.95) FILTER (WHERE x < 'inf'), 4) AS p95, round(quantile_cont(x, 0.99) FILTER (WHERE x < 'inf'), 4) AS p99, round(max(x) FILTER (WHERE x < 'inf'), 4) AS max FROM v GROUP BY priority""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return surface.summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), x.alias("x")), F.col("x"), ["priority"])


@query("""WITH p AS (SELECT CAST(embedding[3] AS DOUBLE) * 1000 AS x, CAST(embedding[4] AS DOUBLE) * 1000 AS y, 1 + vec_id % 97 AS weight FROM embeddings)
SELECT CAST(floor(y / 500) AS BIGINT) AS row, CAST(floor(x / 500) AS BIGINT) AS col, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS cells, round(sum(weight) / 0.25::DOUBLE, 6) AS density_km2 FROM p GROUP BY 1, 2 HAVING sum(weight) > 0""")
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d).select(F.col("e3").alias("x"), F.col("e4").alias("y"), (1 + F.col("vec_id") % 97).alias("weight"))
    return surface.density_grid(p)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""SELECT n_nationkey AS district, {", ".join(f"count(c_custkey) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)}, count(c_custkey) AS "all" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def supply_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("category"))
    return places.supply(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("district")), SEGMENTS)


@query("""SELECT n_nationkey AS district, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers, round(count(DISTINCT s_suppkey) * 10000.0::DOUBLE / nullif(count(DISTINCT c_custkey), 0), 6) AS per_10k,
round(coalesce(count(DISTINCT c_custkey)::DOUBLE / nullif(count(DISTINCT s_suppkey), 0), 0), 6) AS customers_per_supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def per_capita_rates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("district")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("district")).agg(F.count("*").alias("customers"))
    j = n.join(s, "district", "left").join(c, "district", "left").fillna(0)
    per = F.round(access.rate(F.col("suppliers"), F.col("customers"), 10000.0), 6)
    return j.select("*", per.alias("per_10k"), F.round(F.coalesce(F.try_divide(F.col("customers").cast("double"), "suppliers"), F.lit(0.0)), 6).alias("customers_per_supplier"))


@query(f"WITH {CELLS} SELECT district, cell_id, round(metro_d, 6) AS metro_d, metro_d <= {BUDGET_SQL} AS within FROM cells QUALIFY row_number() OVER (PARTITION BY district ORDER BY metro_d, cell_id) = 1")
def nearest_by_group(spark: SparkSession, d: str) -> DataFrame:
    got = b.cells(spark, d).groupBy("district").agg(F.min_by(F.struct("cell_id", "metro_d"), F.struct("metro_d", "cell_id")).alias("m"))
    return got.select("district", "m.cell_id", F.round("m.metro_d", 6).alias("metro_d"), access.within(F.col("m.metro_d"), BUDGET).alias("within"))


@query(f"WITH {CELLS} SELECT cell_id, district, round(metro_d, 6) AS metro_d FROM cells ORDER BY cells.metro_d DESC, cell_id LIMIT 5")
def worst_connectors(spark: SparkSession, d: str) -> DataFrame:
    return b.cells(spark, d).orderBy(F.desc("metro_d"), "cell_id").limit(5).select("cell_id", "district", F.round("metro_d", 6).alias("metro_d"))


@query(f"WITH {NETWORK} SELECT edge_id, u, v, round(cost_m, 4) AS cost_m, records FROM edges")
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    return b.edges(spark, d).withColumn("cost_m", F.round("cost_m", 4))


@query(f"""WITH {NETWORK}, p AS (SELECT u, v, count(*) AS m FROM edges GROUP BY ALL)
SELECT (SELECT count(*) FROM edges) AS edges, (SELECT CAST(sum(records) AS BIGINT) FROM edges) AS records, (SELECT CAST(count_if(u = v) AS BIGINT) FROM edges) AS loops, (SELECT CAST(count_if(records > 1) AS BIGINT) FROM edges) AS merged,
(SELECT round(min(cost_m), 4) FROM edges) AS min_cost, (SELECT round(quantile_cont(cost_m, 0.5), 4) FROM edges) AS median_cost, (SELECT round(max(cost_m), 4) FROM edges) AS max_cost, (SELECT CAST(count_if(cost_m > 300) AS BIGINT) FROM edges) AS over_budget,
(SELECT count(*) FROM p) AS pairs, (SELECT CAST(count_if(m > 1) AS BIGINT) FROM p) AS parallel_pairs, (SELECT max(m) FROM p) AS most_parallel""")
def network_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.network_stats(b.edges(spark, d), 300.0)


@query(f"WITH {NETWORK}, {SNAP} SELECT kind, vec_id, edge_id, round(connector_m, 4) AS connector_m, round(f, 6) AS fraction, round(f * cost_m, 4) AS cost_to_u, round((1 - f) * cost_m, 4) AS cost_to_v FROM snap")
def nearest_edge_snap(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d)
    spot = lambda k, x, y, where: p.where(where).select(F.concat(F.lit(k + ":"), "vec_id").alias("point_id"), F.col(x).alias("x"), F.col(y).alias("y"))
    spots = spot("cell", "e3", "e4", "true").unionByName(spot("metro", "e5", "e6", "vec_id % 50 = 0")).unionByName(spot("bus", "e5", "e6", "vec_id % 11 = 3"))
    s = spatial.snap_to_edges(spots, b.edge_lines(spark, d))
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select(F.substring_index("point_id", ":", 1).alias("kind"), F.substring_index("point_id", ":", -1).cast("long").alias("vec_id"), "edge_id", r("connector_m", 4), r("fraction", 6), r("cost_to_u", 4), r("cost_to_v", 4))


@query(f"""WITH {NETWORK}, {SNAP}, brk AS (SELECT m.mode, edge_id, 0.0::DOUBLE AS f FROM edges CROSS JOIN (VALUES ('metro'), ('bus')) m(mode) UNION SELECT m.mode, edge_id, 1.0::DOUBLE FROM edges CROSS JOIN (VALUES ('metro'), ('bus')) m(mode)
UNION SELECT kind, edge_id, CASE WHEN f * cost_m <= 1e-6 THEN 0 WHEN (1 - f) * cost_m <= 1e-6 THEN 1 ELSE f END FROM snap WHERE kind <> 'cell')
SELECT mode, edge_id, round(f, 6) AS lo, round(lead(f) OVER (PARTITION BY mode, edge_id ORDER BY f), 6) AS hi FROM brk QUALIFY hi IS NOT NULL""")
def break_table(spark: SparkSession, d: str) -> DataFrame:
    return b.Routed(spark, d).segments.select("mode", "edge_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES} SELECT mode, node, round(d, 4) AS distance FROM reach")
def multi_source_distance(spark: SparkSession, d: str) -> DataFrame:
    r = b.Routed(spark, d).reached.where(F.col("node").startswith("n"))
    return r.select("mode", F.substring("node", 2, 20).cast("long").alias("node"), F.round("distance", 4).alias("distance"))


@query(f"WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES} SELECT mode, vec_id, round(distance, 4) AS distance FROM cell_d")
def cell_distance(spark: SparkSession, d: str) -> DataFrame:
    return b.Routed(spark, d).cells().select("mode", F.col("point_id").alias("vec_id"), F.round("distance", 4).alias("distance"))


@query(f"""WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES}, w AS (SELECT p.label AS district, 1 + p.vec_id % 97 AS weight, min(distance) FILTER (WHERE mode = 'metro') AS metro_d, min(distance) FILTER (WHERE mode = 'bus') AS bus_d FROM cell_d JOIN pts p USING (vec_id) GROUP BY p.vec_id, p.label),
s AS (SELECT district, CASE WHEN grouping(district) = 0 THEN 'district' ELSE 'city' END AS scope, {_sums(BUDGET_SQL)} FROM w GROUP BY GROUPING SETS ((district), ())) SELECT *, {PCTS} FROM s""")
def network_access(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: canonical edges, snapping, splicing, routing, cell distances, classes, shares by district and in all."""
    wide = b.Routed(spark, d).cells().groupBy("point_id").agg(*[F.min(F.when(F.col("mode") == m, F.col("distance"))).alias(f"{m}_d") for m in b.MODES])
    p = b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.col("label").alias("district"), (1 + F.col("vec_id") % 97).alias("weight"))
    return access.city_and_groups(wide.join(p, "point_id"), BUDGET)


@query(f"""WITH RECURSIVE {NETWORK}, {SNAP}, {ROUTES}, brk AS (SELECT m.mode, e.edge_id, 0.0::DOUBLE AS f, coalesce(d, 'inf'::DOUBLE) AS d FROM edges e CROSS JOIN (VALUES ('metro'), ('bus')) m(mode) LEFT JOIN reach r ON r.mode = m.mode AND r.node = u
UNION ALL SELECT m.mode, e.edge_id, 1.0::DOUBLE, coalesce(d, 'inf'::DOUBLE) FROM edges e CROSS JOIN (VALUES ('metro'), ('bus')) m(mode) LEFT JOIN reach r ON r.mode = m.mode AND r.node = v
UNION ALL SELECT c.kind, c.edge_id, c.f, least(coalesce(du.d, 'inf'::DOUBLE) + c.f * c.cost_m, coalesce(dv.d, 'inf'::DOUBLE) + (1 - c.f) * c.cost_m, (SELECT min(s.connector_m + abs(c.f - s.f) * c.cost_m) FROM snap s WHERE s.kind = c.kind AND s.edge_id = c.edge_id))
  FROM snap c LEFT JOIN reach du ON du.mode = c.kind AND du.node = c.u LEFT JOIN reach dv ON dv.mode = c.kind AND dv.node = c.v WHERE c.kind <> 'cell' AND c.f * c.cost_m > 1e-6 AND (1 - c.f) * c.cost_m > 1e-6),
seg AS (SELECT mode, edge_id, (lead(f) OVER w - f) * cost_m AS len, d AS da, lead(d) OVER w AS db FROM brk JOIN edges USING (edge_id) WINDOW w AS (PARTITION BY mode, edge_id ORDER BY f) QUALIFY db IS NOT NULL)
SELECT mode, CAST(count_if(da <= 400 AND db <= 400) AS BIGINT) AS whole, CAST(count_if((da <= 400) <> (db <= 400)) AS BIGINT) AS part, CAST(count_if(da > 400 AND db > 400) AS BIGINT) AS none,
round(sum(CASE WHEN da <= 400 AND db <= 400 THEN len ELSE least(len, greatest(0, 400 - da) + greatest(0, 400 - db)) END), 3) AS reachable_m FROM seg GROUP BY mode""")
def service_area_segments(spark: SparkSession, d: str) -> DataFrame:
    r = b.Routed(spark, d)
    return network.service_area(r.segments, r.reached, 400.0)


@query(f"WITH RECURSIVE {NETWORK}, both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges), r AS (SELECT u AS node, least(u, v) AS comp FROM both_ways UNION SELECT a.u, r.comp FROM r JOIN both_ways a ON a.v = r.node) SELECT node, min(comp) AS comp FROM r GROUP BY node")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the whole network."""
    return network.components(b.edges(spark, d))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings), d AS (
SELECT s.vec_id AS station, e.vec_id AS entrance, sqrt((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y)) AS d FROM p s JOIN p e ON s.vec_id % 4 <> 0 AND e.vec_id % 4 = 0), n AS (SELECT station, min(d) AS d FROM d GROUP BY station)
SELECT vec_id AS target_id, 'entrance' AS kind, NULL AS reason FROM p WHERE vec_id % 4 = 0 UNION ALL SELECT station, 'station', 'no entrance within 60 m' FROM n WHERE d > 60""")
def nearest_point_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d).select(F.col("vec_id").alias("target_id"), F.col("e1").alias("x"), F.col("e2").alias("y"))
    return spatial.with_fallback(p.where("target_id % 4 = 0"), p.where("target_id % 4 <> 0"), 60.0)


#: Four boxes that share borders: enough to have points within, on borders and outside.
BOXES = [("a_west", -200.0, -200.0, 0.0, 0.0), ("b_east", 0.0, -200.0, 200.0, 0.0), ("c_north", -200.0, 0.0, 0.0, 200.0), ("d_north_east", 0.0, 0.0, 200.0, 200.0)]
BOXES_SQL = "boxes(name, bx1, by1, bx2, by2) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE, {g}::DOUBLE)" for n, a, c, e, g in BOXES) + ")"


@query(f"""WITH {BOXES_SQL}, p AS (SELECT vec_id, CASE WHEN vec_id % 20 = 0 THEN 0.0::DOUBLE ELSE CAST(embedding[3] AS DOUBLE) * 1000 END AS x, CAST(embedding[4] AS DOUBLE) * 1000 AS y FROM embeddings),
j AS (SELECT vec_id, name, x > bx1 + 1e-3 AND x < bx2 - 1e-3 AND y > by1 + 1e-3 AND y < by2 - 1e-3 AS deep FROM p JOIN boxes ON x >= bx1 - 1e-3 AND x <= bx2 + 1e-3 AND y >= by1 - 1e-3 AND y <= by2 + 1e-3),
g AS (SELECT vec_id, count(*) AS n, CAST(count_if(deep) AS BIGINT) AS n_in, min(name) AS district FROM j GROUP BY vec_id)
SELECT p.vec_id AS point_id, district, CASE WHEN n IS NULL THEN 'outside' WHEN n = 1 AND n_in = 1 THEN 'within' ELSE 'boundary_tie' END AS method FROM p LEFT JOIN g USING (vec_id)""")
def pip_assign(spark: SparkSession, d: str) -> DataFrame:
    rings = spark.createDataFrame([(n, [(a, c), (e, c), (e, g), (a, g)]) for n, a, c, e, g in BOXES], "name string, ring array<struct<x: double, y: double>>")
    p = b.points(spark, d).select(F.col("vec_id").alias("point_id"), F.when(F.col("vec_id") % 20 == 0, 0.0).otherwise(F.col("e3")).alias("x"), F.col("e4").alias("y"))
    return spatial.assign_polygon(p, spatial.ring_edges(rings))


@query(f"""WITH {NETWORK}, wide(name, bx1, by1, bx2, by2) AS (VALUES ('a', -200.0::DOUBLE, -200.0::DOUBLE, 50.0::DOUBLE, 200.0::DOUBLE), ('b', 0.0::DOUBLE, -200.0::DOUBLE, 200.0::DOUBLE, 200.0::DOUBLE)),
l AS (SELECT edge_id, p.e1 AS x1, p.e2 AS y1, q.e1 - p.e1 AS dx, q.e2 - p.e2 AS dy FROM edges JOIN pts p ON p.vec_id = u JOIN pts q ON q.vec_id = v),
c AS (SELECT edge_id, name, sqrt(dx * dx + dy * dy) AS len, greatest(0, least((bx1 - x1) / dx, (bx2 - x1) / dx), least((by1 - y1) / dy, (by2 - y1) / dy)) AS f0, least(1, greatest((bx1 - x1) / dx, (bx2 - x1) / dx), greatest((by1 - y1) / dy, (by2 - y1) / dy)) AS f1 FROM l CROSS JOIN wide),
k AS (SELECT edge_id, len, max(CASE WHEN name = 'a' AND f1 > f0 THEN f0 END) AS a0, max(CASE WHEN name = 'a' AND f1 > f0 THEN f1 END) AS a1, max(CASE WHEN name = 'b' AND f1 > f0 THEN f0 END) AS b0, max(CASE WHEN name = 'b' AND f1 > f0 THEN f1 END) AS b1 FROM c GROUP BY ALL),
o AS (SELECT *, coalesce(greatest(0, least(a1, b1) - greatest(a0, b0)), 0) AS ov FROM (SELECT edge_id, len, a0, a1, b0, b1 FROM k)),
v AS (SELECT sum((a1 - a0) * len) AS a, sum((b1 - b0 - CASE WHEN a0 IS NULL THEN 0 ELSE ov END) * len) AS b, sum(CASE WHEN a0 IS NULL OR b0 IS NULL THEN 0 ELSE ov END * len) AS s FROM o)
SELECT 'a' AS name, round(a / 1000, 6) AS length_km, round(s / 1000, 6) AS shared_km FROM v UNION ALL SELECT 'b', round(b / 1000, 6), 0.0::DOUBLE FROM v""")
def edge_length_partition(spark: SparkSession, d: str) -> DataFrame:
    """Edge length by two boxes that overlap: what both cover counts for the first."""
    boxes = spark.createDataFrame([("a", -200.0, -200.0, 50.0, 200.0), ("b", 0.0, -200.0, 200.0, 200.0)], "name string, bx1 double, by1 double, bx2 double, by2 double")
    return spatial.partition_lengths(b.edge_lines(spark, d), boxes)


@query("""SELECT p_partkey AS id, trim(regexp_replace(translate(lower(coalesce(p_name, '')), '''’‘ʻʼ`´', ''), '[^a-z0-9Ѐ-ӿ]+', ' ', 'g')) AS key, nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), '') AS name FROM part""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.name_key(F.col("p_name")).alias("key"), text.normalised_name(F.col("p_name")).alias("name"))


@query("""SELECT CASE WHEN 'machinery' IN (lower(c_mktsegment), CASE WHEN c_custkey % 5 = 0 THEN 'machinery' END) THEN 'machinery' WHEN lower(c_mktsegment) = 'building' THEN 'building' WHEN lower(c_mktsegment) = 'furniture' THEN 'furniture' END AS category, count(*) AS n FROM customer GROUP BY 1""")
def category_precedence(spark: SparkSession, d: str) -> DataFrame:
    second = F.when(F.col("c_custkey") % 5 == 0, " Machinery ")
    c = text.category([F.col("c_mktsegment"), second], ["machinery", "building", "furniture"])
    return table(spark, d, "customer").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("SELECT event_id, printf('r%05dc%05d', event_id // 100, event_id % 100) AS cell_id FROM events")
def cell_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.cell_id(F.floor(F.col("event_id") / 100).cast("int"), (F.col("event_id") % 100).cast("int")).alias("cell_id"))


@query("SELECT n_regionkey AS region, sha256(string_agg(CAST(n_nationkey AS VARCHAR), chr(10) ORDER BY n_nationkey) || chr(10)) AS digest, count(*) AS n FROM nation GROUP BY 1")
def id_digest(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"), F.count("*").alias("n"))
    return n.select("region", text.ids_digest(F.col("ids")).alias("digest"), "n")


@query("SELECT o_orderpriority AS ref, count(DISTINCT o_orderstatus) AS \"values\", CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS agreed FROM orders GROUP BY 1")
def consensus_values(spark: SparkSession, d: str) -> DataFrame:
    return places.consensus(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "ref"), "ref", "o_orderstatus")


@query()
def path_trace(spark: SparkSession, d: str) -> DataFrame:
    """Each district's nearest cell by metro and the way to it from its entry."""
    r = b.Routed(spark, d)
    dist = r.cells().where("mode = 'metro'").join(b.points(spark, d).select(F.col("vec_id").alias("point_id"), "label"), "point_id")
    best = dist.groupBy("label").agg(F.min_by(F.struct("point_id", "distance"), F.struct("distance", "point_id")).alias("m")).select("label", "m.*")
    at = r.snap.where("kind = 'cell'").select(F.col("vec_id").alias("point_id"), "edge_id", "fraction")
    seg = r.segments.where("mode = 'metro'")
    near = best.join(at, "point_id").join(seg, "edge_id").where("fraction >= lo AND fraction <= hi").select("label", "point_id", "distance", "fraction", "lo", "hi", "a", "b", "cost_m")
    reach = r.reached.where("mode = 'metro'").select("node", F.col("distance").alias("dn"))
    ends = near.select("label", "point_id", "distance", F.explode(F.array(F.struct(F.col("a").alias("node"), ((F.col("fraction") - F.col("lo")) * F.col("cost_m")).alias("c")), F.struct(F.col("b").alias("node"), ((F.col("hi") - F.col("fraction")) * F.col("cost_m")).alias("c")))).alias("e"))
    pick = ends.select("label", "point_id", "distance", "e.node", "e.c").join(reach, "node").groupBy("label", "point_id", "distance").agg(F.min_by("node", F.struct(F.col("dn") + F.col("c"), F.col("node"))).alias("node"))
    paths = network.trace(r.reached, pick.select(F.lit("metro").alias("mode"), "node").distinct())
    return pick.join(paths.drop("mode"), "node").select("label", "point_id", F.round("distance", 4).alias("distance"), F.array_join("path", ">").alias("path"))


@query(f"""WITH {CELLS}, {STATES} SELECT c AS "check", v AS violations FROM (VALUES ('partition', 0::BIGINT), ('unique_cells', 0::BIGINT), ('rollup', 0::BIGINT), ('nested_states', 0::BIGINT), ('state_ids', 0::BIGINT), ('year_grid', 0::BIGINT), ('finite_distances', 0::BIGINT), ('monotone_speed', 0::BIGINT)) t(c, v)""")
def invariants(spark: SparkSession, d: str) -> DataFrame:
    cells = b.cells(spark, d)
    c = access.classes(F.col("metro_d"), F.col("bus_d"), BUDGET)
    both = access.city_and_groups(cells, BUDGET)
    opened = temporal.open_in(b.stations(spark, d), b.years(spark, d))
    states = temporal.source_states(opened)
    speeds = access.by_speed(cells).where("scope = 'district'")
    faster = Window.partitionBy("district").orderBy("speed_kmh")
    parts = [
        checks.violations("partition", cells, sum(f.cast("int") for f in c.values()) != 1),
        checks.rows_of("unique_cells", checks.duplicates(cells, ["cell_id"])),
        checks.rows_of("rollup", checks.rollup_gap(both, "scope", ["total", "metro", "bus_only", "underserved"], 1e-3)),
        checks.rows_of("nested_states", temporal.not_nested(states)),
        checks.rows_of("state_ids", temporal.colliding_states(states)),
        checks.rows_of("year_grid", checks.missing_keys(opened, year=b.years(spark, d))),
        checks.violations("finite_distances", cells, F.isnan("metro_d") | F.isnan("bus_d") | (F.col("metro_d") < 0)),
        checks.violations("monotone_speed", speeds.withColumn("was", F.lag("metro").over(faster)), F.coalesce(F.col("metro") < F.col("was"), F.lit(False))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {ANNUAL}, {YEARS}, k AS (SELECT DISTINCT cell_id FROM annual) SELECT k.cell_id, y.year, round(a.value, 2) AS pop, CASE WHEN a.value IS NULL THEN 'nodata' WHEN y.year >= 1998 THEN 'break' ELSE 'comparable' END AS label
FROM k CROSS JOIN years y LEFT JOIN annual a ON a.cell_id = k.cell_id AND a.year = y.year""")
def unpivot_annual(spark: SparkSession, d: str) -> DataFrame:
    """A wide table with a column for each year, made long, with labels."""
    years = sorted(r[0] for r in b.years(spark, d).collect())  # the columns of the wide table
    wide = b.annual(spark, d).groupBy("cell_id").agg(*[F.sum(F.when(F.col("year") == y, F.col("value"))).alias(f"pop_{y}") for y in years])
    long = wide.unpivot(["cell_id"], [f"pop_{y}" for y in years], "c", "v")
    year = F.substring("c", 5, 4).cast("int")
    label = F.when(F.col("v").isNull(), "nodata").when(year >= 1998, "break").otherwise("comparable")
    return long.select("cell_id", year.alias("year"), F.round("v", 2).alias("pop"), label.alias("label"))


@query("""SELECT event_type, CAST(len(json_keys(props)) AS INTEGER) AS keys, array_to_string(list_sort(json_keys(props)), ',') AS names, count(*) AS n FROM events GROUP BY ALL""")
def tag_json_records(spark: SparkSession, d: str) -> DataFrame:
    """Tallies of the tag sets that JSON properties have."""
    keys = F.json_object_keys("props")
    e = table(spark, d, "events").select("event_type", F.size(keys).alias("keys"), F.array_join(F.array_sort(keys), ",").alias("names"))
    return e.groupBy("event_type", "keys", "names").agg(F.count("*").alias("n"))
