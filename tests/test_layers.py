"""Order-dependent deduplication against a sequential walk, layers, distributed shortest paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netaccess.operators import network, places, relate, shapes, spatial
from netaccess.operators.lineage import dealt


def walked(rows, radius):
    """(id, kept_id) of rows (id, x, y, names) taken in order."""
    kept, out = [], {}
    for i, x, y, names in rows:
        near = next((k for k, a, b, other in kept if names & other and math.dist((x, y), (a, b)) <= radius), None)
        if near is None:
            kept.append((i, x, y, names))
        out[i] = near if near is not None else i
    return out


@pytest.mark.parametrize("n,side,names", [(150, 60.0, 3), (120, 8.0, 2), (80, 300.0, 1)])
def test_dedupe_equals_the_walk(spark, n, side, names):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 0, 1, 2]), rng.uniform(0, side), rng.uniform(0, side), [f"k{rng.randrange(names)}" for _ in range(rng.randint(0, 2))] + rng.choice([[], [None, ""]])) for i in range(n)]
    rows += [(n + i, 0, *rows[i][2:]) for i in range(10)]  # repeated places
    p = spark.createDataFrame(rows, "place_id long, rank int, x double, y double, keys array<string>")
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    clean = [(r[0], r[2], r[3], {k for k in r[4] if k}) for r in order]
    got = places.dedupe_by_names(p, 10.0, ["rank"]).collect()
    assert {r["place_id"]: r["kept_id"] for r in got} == walked(clean, 10.0)
    at = {r[0]: (r[2], r[3]) for r in rows}
    assert all(r["distance"] == pytest.approx(math.dist(at[r["place_id"]], at[r["kept_id"]])) for r in got)
    every = {r["place_id"]: r["kept_id"] for r in places.greedy_dedupe(p, [], 10.0, ["rank"]).collect()}
    assert every == walked([(i, x, y, {"all"}) for i, x, y, _ in clean], 10.0)


def test_dedupe_by_role_and_odd_places(spark):
    rows = [(1, "a", 0.0, 0.0, ["n"]), (2, "b", 0.0, 0.0, ["n"]), (3, "a", 1.0, 0.0, ["n"]), (4, "a", None, 0.0, ["n"]), (5, "a", float("nan"), 0.0, ["n"]), (6, "a", 0.0, 0.0, None), (7, "a", 0.0, 0.0, [])]
    p = spark.createDataFrame(rows, "place_id long, role string, x double, y double, keys array<string>")
    assert {r["place_id"]: r["kept_id"] for r in places.dedupe_by_names(p, 5.0, ["place_id"], by=["role"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert places.dedupe_by_names(p.limit(0), 5.0, ["place_id"]).count() == 0
    # a crowd in one cell: one row of each cell is met, whatever the crowd
    crowd = spark.range(4000).selectExpr("id AS place_id", "cast(id % 7 AS double) / 10 AS x", "0.0D AS y", "'c' AS name")
    assert {r["kept_id"] for r in places.greedy_dedupe(crowd, ["name"], 5.0, ["place_id"]).collect()} == {0}


def test_without_near_shares_any_name(spark):
    s = "id long, x double, y double, keys array<string>"
    rows = spark.createDataFrame([(1, 0.0, 0.0, ["a", "b"]), (2, 0.0, 0.0, ["c"]), (3, 0.0, 0.0, []), (4, 100.0, 0.0, None), (5, 0.0, 0.0, ["", None]), (6, None, 0.0, ["b"])], s)
    others = spark.createDataFrame([(9, 30.0, 0.0, ["b", "z"]), (8, 20.0, 0.0, [])], s)
    assert sorted(r["id"] for r in relate.without_near(rows, others, 50.0, 25.0).collect()) == [2, 4, 6]


@pytest.mark.parametrize("delta", [None, 1.0, 3.0, 1e9])
def test_delta_stepping_equals_dijkstra(spark, delta):
    """Ties, heavy edges, several modes and parts that no entry reaches."""
    rng = random.Random(7)
    adj = [(m, f"n{i}", f"n{rng.randrange(i)}", float(rng.choice([1, 1, 2, 3, 20]))) for m in ("a", "b") for i in range(1, 80) for _ in range(2)]
    adj = list({(m, *sorted((a, b))): (m, a, b, w) for m, a, b, w in adj if a != b}.values()) + [("a", "x1", "x2", 1.0)]
    a = spark.createDataFrame(adj, "mode string, a string, b string, w double")
    e = spark.createDataFrame([("a", "n3", 2.0), ("a", "n40", 0.0), ("b", "n7", 5.0)], "mode string, node string, cost double")
    one = network.multi_source_distances(a, e, distributed=False)
    many = network.multi_source_distances(a, e, distributed=True, delta=delta)
    key = lambda df: sorted((r["mode"], r["node"], r["distance"], r["before"] or "") for r in df.collect())
    assert key(one) == key(many)


def test_a_way_that_leaves_its_polygon(spark):
    """A street from left to right in four edges; the polygon ends in the middle of the third."""
    segs = spark.createDataFrame([("m", i, 0.0, 1.0, f"n{i}", f"n{i + 1}", 10.0) for i in range(4)] + [("m", 9, 0.0, 1.0, "n0", "n1", 99.0)], "mode string, edge_id long, lo double, hi double, a string, b string, cost_m double")
    lines = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * (i + 1), 0.0) for i in range(4)] + [(9, 0.0, 0.0, 10.0, 0.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    paths = spark.createDataFrame([("m", "n4", ["n0", "n1", "n2", "n3", "n4"]), ("m", "n2", ["n0", "n1", "n2"]), ("m", "n0", ["n0"]), ("m", "n3", ["n4", "n3"])], "mode string, node string, path array<string>")
    legs = network.path_legs(paths, segs)
    assert sorted((r["node"], r["leg"], r["edge_id"]) for r in legs.collect()) == [("n2", 1, 0), ("n2", 2, 1), ("n3", 1, 3), ("n4", 1, 0), ("n4", 2, 1), ("n4", 3, 2), ("n4", 4, 3)]
    sides = spatial.ring_edges(spark.createDataFrame([("p", [(-5.0, -5.0), (25.0, -5.0), (25.0, 5.0), (-5.0, 5.0)])], "name string, ring array<struct<x: double, y: double>>"))
    got = network.leaving(legs.withColumn("name", F.lit("p")), shapes.inside_parts(lines, sides)).collect()
    assert {r["node"]: (r["legs"], r["crosses"], r["first_leg"]) for r in got} == {"n4": (4, True, 3), "n2": (2, False, None), "n3": (1, True, 1)}


def test_edges_stay_where_they_are_dealt(spark):
    edges = dealt(spark.range(1000).selectExpr("substring(concat('m', id), 1, 1) AS mode", "id % 97 AS a", "id AS b"), 4, "mode", "a")
    assert edges.rdd.getNumPartitions() == 4 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    front = spark.range(200).selectExpr("substring(concat('m', id), 1, 1) AS mode", "id AS node")
    plan = front.join(edges.hint("merge"), (front.mode == edges.mode) & (front.node == edges.a))._jdf.queryExecution().executedPlan().toString()
    # the front alone is shuffled
    assert plan.count("Exchange hashpartitioning") == 1


def test_splice_is_dealt_to_all_cores(spark):
    edges = spark.range(40).selectExpr("id AS edge_id", "id AS u", "id + 1 AS v", "10.0D AS cost_m")
    snaps = spark.range(200).selectExpr("'m' AS mode", "concat('m:', id) AS point_id", "id % 40 AS edge_id", "(id div 40) / 4.0D AS fraction", "1.0D AS connector_m")
    got = network.splice(edges, snaps)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    # five sources an edge: one at each end, three between; and both ends
    assert got.count() == 40 * 7 and got.select("node").distinct().count() == 41 + 40 * 3
