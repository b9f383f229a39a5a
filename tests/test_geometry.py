"""Overlay, rings, rasters, bent lines, coverage and quantiles against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netaccess.operators import elements, lines, overlay, quantiles, shapes, spatial


def sides_of(spark, polygons):
    """Sides of (layer, name, ring)."""
    rows = [(la, n, *map(float, (*a, *b))) for la, n, r in polygons for a, b in zip(r, r[1:] + r[:1], strict=True)]
    return spark.createDataFrame(rows, "layer string, name string, x1 double, y1 double, x2 double, y2 double")


def inside(ring, x, y):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
            odd = not odd
    return odd


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_overlay_of_random_triangles_equals_sampling(spark):
    rng = random.Random(5)
    polygons = [("L", f"t{i}", [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3)]) for i in range(9)] + [("L", "star", [(10, 0), (13, 18), (1, 6), (19, 6), (7, 18)])]
    f = overlay.cut(overlay.faces(sides_of(spark, polygons)))
    n, g = 400, 0.05
    dots = [((i + 0.37) * g, (j + 0.41) * g) for i in range(n) for j in range(n)]
    held = np.array([[inside(r, x, y) for x, y in dots] for _, _, r in polygons])
    near = lambda a, b: abs(a - b) < 0.02 * b + 0.6
    assert near(overlay.area_where(f).first()["area"], held.any(0).sum() * g * g)
    assert near(overlay.area_where(f, lambda m: F.size(m) == 2).first()["area"], (held.sum(0) == 2).sum() * g * g)
    names = [p[1] for p in polygons]
    for r in overlay.areas(f).collect():
        assert near(r["area"], held[names.index(r["name"])].sum() * g * g)
    pairs = {(r["a"], r["b"]): r["area"] for r in overlay.overlaps(f).collect()}
    for i, a in enumerate(names):
        for j, c in enumerate(names):
            if a < c:
                assert near(pairs.get((a, c), 0.0), (held[i] & held[j]).sum() * g * g)
    rings = overlay.linked(overlay.outline(f)).collect()
    assert sum(r["area"] for r in rings) == pytest.approx(overlay.area_where(f).first()["area"])


def test_overlay_of_shared_borders_holes_and_touching_corners(spark):
    shape = [("a", "w", box(0, 0, 10, 10)), ("a", "e", box(10, 0, 10, 10)), ("b", "outer", box(0, 0, 9, 9)), ("b", "outer", box(3, 3, 3, 3)), ("c", "p", box(0, 0, 5, 5)), ("c", "q", box(5, 5, 5, 5)), ("d", "flat", [(0, 0), (1, 0), (2, 0)])]
    f = overlay.cut(overlay.faces(sides_of(spark, shape)))
    assert {r["layer"]: r["area"] for r in overlay.area_where(f).collect() if r["area"]} == {"a": 200.0, "b": 72.0, "c": 50.0}
    assert overlay.overlaps(f).where("abs(area) > 1e-9").count() == 0
    rings = overlay.nested(overlay.linked(overlay.outline(f))).collect()
    found = sorted((r["layer"], r["area"], r["ring"], r["outer"]) for r in rings)
    assert found == [("a", 200.0, 1, 1), ("b", -9.0, 2, 1), ("b", 81.0, 1, 1), ("c", 25.0, 1, 1), ("c", 25.0, 2, 2)]
    assert {r["layer"]: r["area"] for r in overlay.area_where(f, overlay.only("w", "e")).collect()}["a"] == 100.0
    assert overlay.faces(sides_of(spark, shape).limit(0)).count() == 0


def test_points_lie_inside_whatever_the_shape(spark):
    comb = [(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (5, 1), (5, 9), (4, 9), (4, 1), (1, 1), (1, 9), (0, 9)]
    polygons = [("l", "comb", comb), ("l", "ring", box(0, 0, 10, 10)), ("l", "ring", box(1, 1, 8, 8)), ("l", "two", box(0, 0, 1, 1)), ("l", "two", box(0, 50, 2, 2)), ("l", "thin", [(0, 0), (100, 0.001), (100, 0.002)])]
    got = {r["name"]: (r["x"], r["y"]) for r in overlay.points_inside(sides_of(spark, polygons)).collect()}
    assert set(got) == {"comb", "ring", "two", "thin"}
    for name, (x, y) in got.items():
        assert sum(inside(r, x, y) for _, n, r in polygons if n == name) % 2 == 1


def test_relations_become_areas(spark):
    way = lambda role, *ps: f'{{"role":"{role}","geometry":[' + ",".join(f'{{"lat":{y},"lon":{x}}}' for x, y in ps) + "]}"
    nested = [way("outer", (0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), way("", (2, 2), (4, 2), (4, 4), (2, 4), (2, 2)), way("inner", (5, 5), (8, 5), (8, 8)), way("inner", (5, 5), (5, 8), (8, 8))]
    rows = [f'{{"type":"relation","id":1,"tags":{{"name":"A"}},"members":[{",".join(nested)}]}}', '{"type":"relation","id":2,"members":[' + way("outer", (0, 0), (1, 1)) + '],"center":{"lat":3,"lon":4}}', '{"type":"relation","id":3}', '{"type":"node","id":1,"lat":7,"lon":8}', "x"]
    raw = spark.createDataFrame([(r,) for r in rows], "j string")
    got = elements.relation_polygons(raw, "j").collect()
    assert [(r["id"], r["area"], r["outers"], r["holes"]) for r in got] == [(1, 72.0, 1, 1)]
    assert not 5 < got[0]["x"] < 8 or not 5 < got[0]["y"] < 8
    every = {(r["type"], r["id"]): (r["method"], r["rank"]) for r in elements.elements_with_areas(raw, "j").collect()}
    assert every == {("relation", 1): ("relation_area", 0), ("relation", 2): ("relation_center", 2), ("node", 1): ("node", 2)}


def test_rasterized_equals_the_centre_test(spark):
    rng = random.Random(2)
    polygons = [("l", f"p{i}", [(rng.uniform(-20, 120), rng.uniform(-20, 120)) for _ in range(5)]) for i in range(4)] + [("l", "grid", box(15, 15, 30, 20))]
    got = {(r["name"], r["row"], r["col"]) for r in shapes.rasterized(sides_of(spark, polygons), 0.0, 100.0, 10.0, 10, 10).collect()}
    for row in range(10):
        for col in range(10):
            x, y = (col + 0.5) * 10, 100 - (row + 0.5) * 10
            for _, n, r in polygons:
                want = inside(r, x, y) if n != "grid" else 15 <= x <= 45 and 15 <= y <= 35
                assert ((n, row, col) in got) == want, (n, row, col)


def test_points_in_bands_equal_the_definition(spark):
    rng = random.Random(9)
    polygons = [("l", f"p{i}", [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(6)]) for i in range(4)]
    points = [(i, rng.uniform(-5, 55), rng.uniform(-5, 55)) for i in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(points, "point_id long, x double, y double")
    got = {(r["point_id"], r["name"]) for r in spatial.held_by(df, sides_of(spark, polygons)).where("inside").collect()}
    assert got == {(i, n) for i, x, y in points[:300] for _, n, r in polygons if inside(r, x, y)}
    assert {r["method"] for r in spatial.assign_polygon(df.where("point_id >= 900"), sides_of(spark, polygons)).collect()} == {"outside"}


def test_bent_lines(spark):
    rows = [(1, 10.0, [(0, 0), (3, 0), (3, 4), (6, 4)]), (2, 5.0, [(0, 9), (9, 9)]), (3, 1.0, [(1, 1)]), (4, 1.0, [(2, 2), (2, 2)]), (5, 1.0, None), (6, 1.0, [(0.0, 0.0), (float("nan"), 1.0)])]
    df = spark.createDataFrame([(i, c, [(float(x), float(y)) for x, y in p] if p else None) for i, c, p in rows], f"edge_id long, cost_m double, points array<{lines.POINT}>")
    got = {(r["edge_id"], r["part"]): (r["from_f"], r["to_f"]) for r in lines.parts(df).collect()}
    assert got == {(1, 0): (0.0, 0.3), (1, 1): (0.3, 0.7), (1, 2): (0.7, 1.0), (2, 0): (0.0, 1.0), (4, 0): (0.0, 0.0)}
    at = spark.createDataFrame([(1, 0.5), (1, 0.3), (1, 2.0), (4, 0.5), (5, 0.5)], "edge_id long, fraction double")
    xy = {(r["edge_id"], r["fraction"]): (r["x"], r["y"]) for r in lines.positions(df, at).collect()}
    assert xy[1, 0.5] == pytest.approx((3, 2)) and xy[1, 0.3] == pytest.approx((3, 0)) and xy[1, 2.0] == pytest.approx((6, 4)) and xy[4, 0.5] == (2, 2) and xy[5, 0.5] == (None, None)
    cuts = lines.sublines(df, spark.createDataFrame([(1, 0.1, 0.8), (1, 0.3, 0.7), (1, 0.4, 0.5)], "edge_id long, f0 double, f1 double")).collect()
    ways = {r["f0"]: [(round(p["x"], 9), round(p["y"], 9)) for p in r["points"]] for r in cuts}
    assert ways == {0.1: [(1, 0), (3, 0), (3, 4), (4, 4)], 0.3: [(3, 0), (3, 4)], 0.4: [(3, 1), (3, 2)]}
    snapped = lines.snap(spark.createDataFrame([(7, 3.5, 2.0), (8, 4.0, 20.0)], "point_id long, x double, y double"), df).collect()
    assert {r["point_id"]: (r["edge_id"], round(r["fraction"], 9), round(r["connector_m"], 9), round(r["cost_to_u"], 9)) for r in snapped} == {7: (1, 0.5, 0.5, 5.0), 8: (2, round(4 / 9, 9), 11.0, round(20 / 9, 9))}


def test_coverage_is_within_one_percent(spark):
    rng = np.random.default_rng(3)
    parts = [(0.0, 0.0, 100.0, 0.0), (0.0, 0.0, 60.0, 80.0), (100.0, 0.0, 60.0, 80.0), (300.0, 300.0, 300.0, 300.0)]
    df = spark.createDataFrame([("m", *p) for p in parts], "layer string, x1 double, y1 double, x2 double, y2 double")
    cells = overlay.cut(lines.coverage(df, 15.0, 4.0))
    dots = rng.uniform((-30, -30), (330, 330), (400_000, 2))
    near = np.zeros(len(dots), dtype=bool)
    for a, b, c, d in parts:
        v = np.array([c - a, d - b])
        t = np.clip(((dots - (a, b)) @ v) / max(v @ v, 1e-12), 0, 1)[:, None]
        near |= np.hypot(*(dots - (a, b) - t * v).T) <= 15
    want = near.mean() * 360 * 360 / 1e6
    assert lines.covered_km2(cells, 4.0).first()["km2"] == pytest.approx(want, rel=0.015)
    rings = lines.coverage_rings(cells, 4.0).collect()
    assert sum(r["area"] > 0 for r in rings) == 2 and sum(r["area"] < 0 for r in rings) == 1  # a dot, and a triangle with its hole
    assert sum(r["area"] for r in rings) / 1e6 == pytest.approx(want, rel=0.03)


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 5.0, 1e12 * rng.random(), -3.0])) for _ in range(4000)]
    rows += [("one", 2.0), ("none", None), ("none", float("nan")), ("same", 7.0), ("same", 7.0), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.013, 0.5, 0.95, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, "v", shares, ["g"]).collect()}
    assert "none" not in got and got["one"] == (1, [2.0] * 5) and got["same"] == (2, [7.0] * 5)
    for g in ("a", "b", None):
        mine = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        assert got[g][0] == len(mine) and got[g][1] == pytest.approx(np.quantile(mine, shares).tolist(), rel=1e-12)
    whole = quantiles.exact_quantiles(df, "v", [0.5], []).first()
    assert whole["q"][0] == pytest.approx(np.median([v for _, v in rows if v is not None and math.isfinite(v)]))
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5], []).count() == 0


def nearest_by_hand(px, py, segments):
    best = None
    for e, x1, y1, x2, y2 in segments:
        dx, dy = x2 - x1, y2 - y1
        l2 = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / l2)) if l2 > 0 else 0.0
        qx, qy = x1 + t * dx, y1 + t * dy
        best = min(best or (math.inf,), (math.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), e, t))
    return best


def test_nearest_search_sorts_no_pairs_and_equals_the_definition(spark, monkeypatch):
    rng = random.Random(11)
    xy = lambda: (rng.gauss(0, 100), rng.gauss(0, 100))
    segments = [(i, *xy(), *xy()) for i in range(300)] + [(300, 5.0, 5.0, 5.0, 5.0), (301, 5.0, 5.0, 5.0, 5.0)]
    points = [(f"p{i}", *xy()) for i in range(400)] + [("far", 9e5, -7e5), ("spot", 5.0, 5.0), ("again", 5.0, 5.0), ("nan", math.nan, 0.0)]
    plans, keep = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), keep(df))[1])
    p, s = spark.createDataFrame(points, "point_id string, x double, y double"), spark.createDataFrame([(*r, 1.0) for r in segments], "edge_id long, x1 double, y1 double, x2 double, y2 double, cost_m double")
    got = {r.point_id: (r.connector_m, r.edge_id, r.fraction) for r in spatial.snap_to_edges(p, s).collect()}
    assert got == {i: nearest_by_hand(x, y, segments) for i, x, y in points if i != "nan"}
    # the least distance is found while the join runs: before, every pair of a place and an edge was sorted, and spilled
    least = [plan for columns, plan in plans if columns[-1] == "low"]
    assert least and all("SortAggregate" not in plan for plan in least)


def test_things_lie_in_a_bounded_number_of_cells(spark, monkeypatch):
    """However many there are, and however many share one place."""
    rng, loads, keep = random.Random(2), [], overlay.cells_crossed

    def counted(rows, *args):
        tiles = keep(rows, *args)
        loads.append((rows.count(), tiles.count()))
        return tiles

    monkeypatch.setattr(overlay, "cells_crossed", counted)
    for n in (200, 3200):
        ends = [[rng.uniform(0, 500) for _ in range(4)] for _ in range(n)]
        s = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(ends + [[1.0, 1.0, 2.0, 2.0]] * n)], "edge_id long, x1 double, y1 double, x2 double, y2 double, cost_m double")
        p = spark.createDataFrame([(i, 1.0, 2.0) for i in range(n)], "point_id long, x double, y double")
        got = spatial.snap_to_edges(p, s)
        assert got.count() == n and got.select("edge_id").distinct().count() == 1
    assert all(distinct <= 3201 and tiles <= 64 * distinct for distinct, tiles in loads)


def test_coverage_sends_the_border_alone(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 300.0, 200.0), ("a", 0.0, 200.0, 300.0, 0.0), ("b", 7.0, 7.0, 7.0, 7.0)], "layer string, x1 double, y1 double, x2 double, y2 double")
    seen = lambda: sorted(map(tuple, lines.coverage(rows, 25.0, 10.0).collect()))
    sent = seen()
    assert "BroadcastHashJoin" in lines.coverage(rows, 25.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lines, "BORDER_CELLS", 0)
    assert seen() == sent
    assert abs(sum(share for la, _, _, share in sent if la == "b") * 100 - math.pi * 625) < 25


def test_linking_takes_rounds_by_the_longest_ring(spark, monkeypatch):
    """Not by the number of pieces: many small rings were linked in as many rounds as one long ring."""
    squares = [("L", f"q{i}", box(3 * (i % 40), 3 * (i // 40), 2, 2)) for i in range(400)]
    out = overlay.cut(sides_of(spark, squares).drop("name"))
    rounds, keep = [], overlay.cut
    monkeypatch.setattr(overlay, "cut", lambda df: (rounds.append(df.columns), keep(df))[1])
    rings = overlay.linked(out).collect()
    assert len(rings) == 400 and all(r.area == 4.0 and len(r.points) == 4 for r in rings)
    assert len([c for c in rounds if "hop" in c and "low" in c]) <= 8
