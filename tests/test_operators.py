import math
import random

import pytest
from pyspark.sql import functions as F

from netaccess.functions import text
from netaccess.operators import access, checks, network, places, spatial, surface, temporal, weights
from netaccess.plans import bindings, catalogue
from netaccess.sources import files


def routed(spark, nodes, edges, sources, cells):
    """Distances of cells to the nearest source: snap, splice, route, bracket."""
    lines = spark.createDataFrame([(i, u, v, float(c), *map(float, nodes[u]), *map(float, nodes[v])) for i, (u, v, c) in enumerate(edges)], "edge_id long, u long, v long, cost_m double, x1 double, y1 double, x2 double, y2 double")
    pts = lambda ps: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(ps)], "point_id long, x double, y double")
    snap = spatial.snap_to_edges(pts(sources), lines).withColumn("mode", F.lit("m"))
    spliced = network.splice(lines, snap)
    breaks = network.break_table(lines, spliced, ["m"])
    segs = network.segments(breaks, lines).cache()
    entries = spliced.where("connector_m IS NOT NULL").select("mode", "node", F.col("connector_m").alias("cost"))
    reached = network.multi_source_distances(network.adjacency(segs), entries)
    got = network.cell_distances(spatial.snap_to_edges(pts(cells), lines), segs, reached)
    return {r["point_id"]: r["distance"] for r in got.collect()}, segs, reached, entries


CASES = [
    ([(0, 0), (1000, 0)], [(0, 1, 1000)], [(500, 30)], [(550, 20)], [100.0]),
    ([(0, 0), (100, 0), (300, 0), (600, 0)], [(0, 1, 100), (1, 2, 200), (2, 3, 300)], [(100, 0)], [(0, 0), (300, 0), (600, 0)], [100.0, 200.0, 500.0]),
    ([(0, 0), (1000, 0)], [(0, 1, 1000)], [(200, 0), (800, 0)], [(x, 0) for x in (100, 300, 500, 700, 900)], [100.0, 100.0, 300.0, 100.0, 100.0]),
    ([(0, 0), (100, 0), (5000, 0), (5100, 0)], [(0, 1, 100), (2, 3, 100)], [(50, 0)], [(50, 0), (5050, 0)], [0.0, math.inf]),
    ([(0, 0), (400, 0), (900, 0)], [(0, 1, 400), (1, 2, 500)], [(100, 40)], [(700, 25)], [665.0]),
    ([(0, 0), (6000, 0)], [(0, 1, 6000)], [(3000, 0)], [(x, 0) for x in (2300, 2900, 3000, 3700, 3900)], [700.0, 100.0, 0.0, 700.0, 900.0]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_routing_cases(spark, case):
    nodes, edges, sources, cells, want = CASES[case]
    got, segs, reached, _ = routed(spark, nodes, edges, sources, cells)
    assert [got[i] for i in range(len(want))] == pytest.approx(want)
    if case == 5:
        assert network.service_area(segs, reached, 800.0).first()["reachable_m"] == pytest.approx(1600.0)


def test_random_network_against_brute_force_and_both_searches(spark):
    rng = random.Random(20260909)
    nodes = [(rng.uniform(0, 1200), rng.uniform(0, 1200)) for _ in range(12)]
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(18)}
    edges = [(u, v, math.dist(nodes[u], nodes[v]) * rng.uniform(0.98, 1.02)) for u, v in sorted(pairs)]
    sources, cells = [[(rng.uniform(0, 1200), rng.uniform(0, 1200)) for _ in range(n)] for n in (4, 20)]
    got, segs, reached, entries = routed(spark, nodes, edges, sources, cells)

    def snap(p):
        best = None
        for i, (u, v, c) in enumerate(edges):
            (x1, y1), (x2, y2) = nodes[u], nodes[v]
            l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / l2))
            d = math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
            best = min(best or (d, i, t), (d, i, t))
        return best

    D = [[0.0 if i == j else math.inf for j in range(12)] for i in range(12)]
    for u, v, c in edges:
        D[u][v] = D[v][u] = min(D[u][v], c)
    for k in range(12):
        for i in range(12):
            for j in range(12):
                D[i][j] = min(D[i][j], D[i][k] + D[k][j])
    for n, p in enumerate(cells):
        dc, ec, fc = snap(p)
        u, v, c = edges[ec]
        want = math.inf
        for s in sources:
            ds, es, fs = snap(s)
            a, b, w = edges[es]
            ways = [x + D[m][o] + y for m, x in ((u, fc * c), (v, (1 - fc) * c)) for o, y in ((a, fs * w), (b, (1 - fs) * w))]
            if ec == es:
                ways.append(abs(fc - fs) * c)
            want = min(want, dc + ds + min(ways))
        assert got[n] == pytest.approx(want, abs=1e-6)
    other = network.multi_source_distances(network.adjacency(segs), entries, distributed=True)
    a, b = ({r["node"]: r["distance"] for r in t.collect()} for t in (reached, other))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_directional_duplicates_and_parallel_edges(spark):
    rec = spark.createDataFrame([(1, 2, 100.0), (2, 1, 100.0), (2, 3, 100.0), (3, 2, 100.0), (1, 2, 500.0), (1, 3, -1.0), (1, 3, float("nan")), (None, 1, 5.0)], "u long, v long, cost double")
    got = network.canonical_edges(rec).orderBy("edge_id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 100.0, 2), (1, 1, 2, 500.0, 1), (2, 2, 3, 100.0, 2)]
    assert {(r["u"], r["v"]): r["cost_m"] for r in network.cheapest_pairs(network.canonical_edges(rec)).collect()} == {(1, 2): 100.0, (2, 3): 100.0}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "u long, v long")
    assert {r["comp"] for r in network.components(e).collect()} == {0, 50}


def test_components_has_every_edge(spark):
    d = "/root/testdata/sf0.001"
    edges = [(r["u"], r["v"]) for r in bindings.edges(spark, d).collect()]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["comp"] for r in catalogue.QUERIES["components"](spark, d).collect()}
    assert got == root


def test_thresholds_and_partition(spark):
    df = spark.createDataFrame([("a", "A", 10.0, 800.0, 900.0), ("b", "A", 20.0, 800.000001, 800.0), ("c", "B", 30.0, math.inf, math.inf)], "cell_id string, district string, weight double, metro_d double, bus_d double")
    got = access.city_and_groups(df, 800.0).where("scope = 'city'").first()
    assert (got["metro"], got["bus_only"], got["underserved"]) == (10.0, 20.0, 30.0)
    c = access.classes(F.col("metro_d"), F.col("bus_d"), 800.0)
    assert checks.violations("partition", df, sum(f.cast("int") for f in c.values()) != 1).first()["violations"] == 0
    nan = df.withColumn("metro_d", F.lit(float("nan")))
    with pytest.raises(ValueError):
        checks.demand(checks.violations("finite", nan, F.isnan("metro_d")))
    assert access.budget_m(4.8) == pytest.approx(800)


def test_missing_weights(spark):
    df = spark.createDataFrame([("x", 10.0, True), ("x", float("nan"), True), ("x", 30.0, False), ("y", None, True)], "g string, w double, ok boolean")
    got = {r["g"]: (r["denominator"], r["numerator"], r["pct"]) for r in access.weighted_access(df, F.col("w"), F.col("ok"), ["g"]).collect()}
    assert got == {"x": (40.0, 10.0, 25.0), "y": (None, None, None)}


def test_calibration_conserves(spark):
    raw = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 1.0)], "k string, raw double")
    control = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("d", 1.0)], "k string, control double")
    for lack in ("k <> 'c'", "k <> 'd'"):  # a control without rows, rows without a control
        with pytest.raises(ValueError, match="no rows|no control"):
            weights.calibrate(raw.where(lack), control.where(lack), ["k"])
    with pytest.raises(ValueError, match="no positive sum"):
        weights.calibrate(raw.where("k = 'a'").withColumn("raw", F.lit(0.0)), control.where("k = 'a'"), ["k"])
    both = "k IN ('a', 'b')"
    got = {r["k"]: r["s"] for r in weights.calibrate(raw.where(both), control.where(both), ["k"]).groupBy("k").agg(F.sum("calibrated").alias("s")).collect()}
    assert got == {"a": 8.0, "b": 1.0}
    assert {tuple(r) for r in weights.missing_controls(raw, control, ["k"]).collect()} == {("c", "control"), ("d", "raw")}


def test_nested_states(spark):
    st = spark.createDataFrame([("a", "A", 2010), ("b", "B", 2020), ("c", "C", 2020), ("d", "D", 2023)], "station_id string, name string, opening_year int")
    years = spark.createDataFrame([(2019,), (2020,), (2021,), (2023,)], "year int")
    states = temporal.source_states(temporal.open_in(st, years))
    assert {(r["state_id"], tuple(r["years"])) for r in states.collect()} == {("state_1", (2019,)), ("state_3", (2020, 2021)), ("state_4", (2023,))}
    assert temporal.not_nested(states).count() == temporal.colliding_states(states).count() == 0


def test_polygons(spark):
    rings = spark.createDataFrame([("east", [(100.0, 0.0), (200.0, 0.0), (200.0, 100.0), (100.0, 100.0)]), ("west", [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)])], "name string, ring array<struct<x: double, y: double>>")
    p = spark.createDataFrame([(1, 50.0, 50.0), (2, 5000.0, 50.0), (3, 290.0, 50.0), (4, 100.0, 50.0)], "point_id int, x double, y double")
    got = {r["point_id"]: (r["district"], r["method"]) for r in spatial.assign_polygon(p, spatial.ring_edges(rings)).collect()}
    assert got == {1: ("west", "within"), 2: (None, "outside"), 3: (None, "outside"), 4: ("east", "boundary_tie")}
    edges = spark.createDataFrame([(0, 10.0, 50.0, 190.0, 50.0), (1, 100.0, 10.0, 100.0, 90.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    boxes = spark.createDataFrame([("west", 0.0, 0.0, 100.0, 100.0), ("east", 100.0, 0.0, 200.0, 100.0)], "name string, bx1 double, by1 double, bx2 double, by2 double")
    got = {r["name"]: (r["length_km"], r["shared_km"]) for r in spatial.partition_lengths(edges, boxes).collect()}
    assert got == {"east": (0.17, 0.08), "west": (0.09, 0.0)}


def test_greedy_dedupe(spark):
    rows = [("n1", "hospital", "A", 50.0, 50.0, 2), ("w1", "hospital", "A", 52.0, 50.0, 0), ("u1", "hospital", None, 0.0, 0.0, 2), ("u2", "hospital", None, 5.0, 0.0, 2), ("c1", "clinic", "A", 51.0, 50.0, 2), ("f1", "hospital", "A", 5000.0, 0.0, 2), ("m1", "hospital", "A", 127.0, 50.0, 2)]
    df = spark.createDataFrame(rows, "place_id string, category string, name string, x double, y double, rank int")
    got = {r["place_id"]: r["kept_id"] for r in places.greedy_dedupe(df, ["category", "name"], 150.0, ["rank", "place_id"]).collect()}
    assert got == {"n1": "w1", "w1": "w1", "u1": "u1", "u2": "u2", "c1": "c1", "f1": "f1", "m1": "w1"}


def test_text(spark):
    df = spark.createDataFrame([("  Oʻzbek   ko'chasi ",), (None,), ("Ташкент-2",)], "s string")
    got = df.select(text.name_key(F.col("s")), text.normalised_name(F.col("s")), text.match_key("s"), text.is_latin(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("ozbek kochasi", "Oʻzbek ko'chasi", "ozbekkochasi", True), ("", None, "", False), ("ташкент 2", "Ташкент-2", "2", False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,ok,name\n1,2.5,True,a\n2,,False,b\n")
    got = files.strict_csv(spark, str(tmp_path / "a.csv"))
    assert dict(got.dtypes) == {"id": "bigint", "x": "double", "ok": "boolean", "name": "string"} and got.where("x IS NULL").count() == 1
    (tmp_path / "b.csv").write_text("x\n1\nb\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "g.graphml").write_text('<graphml>\n<key id="d0" for="edge" attr.name="length" attr.type="double"/>\n<graph>\n<node id="1"></node>\n<node id="2"></node>\n<edge source="1" target="2"><data key="d0">12.5</data></edge>\n</graph></graphml>')
    _, edges = files.graphml(spark, str(tmp_path / "g.graphml"))
    assert [(r["source"], r["attributes"]) for r in edges.collect()] == [("1", {"length": "12.5"})]
    with pytest.raises(ValueError):
        files.canonical_json(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])


def test_surface_of_equal_surfaces(spark):
    a = spark.createDataFrame([(i, float(i + 1)) for i in range(20)], "k long, value double")
    r = surface.compare(a, a.withColumn("value", F.col("value") * 2), "k").first()
    assert (r["r"], r["k"], r["total_ratio"], r["mae"], r["near_median"]) == (1.0, 2.0, 2.0, 0.0, 1.0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 1
    assert set(e.oracle_sql()) <= set(e.queries())
