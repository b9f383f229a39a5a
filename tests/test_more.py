import json
import math
import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from netaccess.functions import text
from netaccess.operators import access, checks, elements, ledger, network, places, relate, shapes, spatial, surface
from netaccess.sources import files, remote


def sides(spark, **polygons):
    rows = [(n, [(float(x), float(y)) for x, y in ring]) for n, ring in polygons.items()]
    return spatial.ring_edges(spark.createDataFrame(rows, "name string, ring array<struct<x: double, y: double>>"))


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


# --- network


def test_paths_are_the_same_either_way(spark):
    rng = random.Random(1)
    adj = [("m", f"n{i}", f"n{rng.randrange(i)}", float(rng.randint(1, 9)) + i / 1000) for i in range(1, 60)] + [("m", "x1", "x2", 1.0)]
    a = spark.createDataFrame(adj, "mode string, a string, b string, w double")
    e = spark.createDataFrame([("m", "n3", 2.0), ("m", "n40", 0.5)], "mode string, node string, cost double")
    one, many = (network.multi_source_distances(a, e, distributed=x) for x in (False, True))
    key = lambda df: sorted((r["node"], round(r["distance"], 9), r["before"]) for r in df.collect())
    assert key(one) == key(many) and "x1" not in {r[0] for r in key(one)}
    t = spark.createDataFrame([("m", "n59"), ("m", "n3"), ("m", "x2")], "mode string, node string")
    trace = lambda df: {r["node"]: r["path"] for r in network.trace(df, t).collect()}
    got = trace(one)
    assert got == trace(many) and got["n59"][-1] == "n59" and got["n59"][0] in ("n3", "n40") and got["n3"] == ["n3"] and got["x2"] == []
    with pytest.raises(ValueError, match="no source"):
        network.multi_source_distances(a, e.limit(0))


def test_lines_turn_with_their_ends(spark):
    rows = [(2, 1, 5.0, "LINESTRING (9 9, 5 5, 0 0)"), (1, 2, 5.0, "LINESTRING (0 0, 5 5, 9 9)"), (1, 2, 5.0, "LINESTRING (0 0, 7 7, 9 9)"), (3, 3, 4.0, "LINESTRING (2 2, 1 1, 0 0, 2 2)"), (3, 3, 4.0, "LINESTRING (2 2, 0 0, 1 1, 2 2)"), (1, 2, None, "x"), (1, 2, -1.0, "x")]
    got = network.canonical_lines(spark.createDataFrame(rows, "u long, v long, cost double, wkt string")).collect()
    assert sorted((r["u"], r["v"], r["wkt"], r["records"]) for r in got) == [(1, 2, "LINESTRING (0 0, 5 5, 9 9)", 2), (1, 2, "LINESTRING (0 0, 7 7, 9 9)", 1), (3, 3, "LINESTRING (2 2, 0 0, 1 1, 2 2)", 2)]
    with pytest.raises(ValueError, match="expected 9"):
        network.guarded(spark.range(3), 9, "nodes")


def test_nearest_search_loses_no_point(spark):
    edges = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 5e6, 5e6, 5e6, 5e6), (3, 1.0, None, 0.0, 1.0, 1.0)], "edge_id long, cost_m double, x1 double, y1 double, x2 double, y2 double")
    rng = random.Random(2)
    pts = [(i, rng.uniform(-1e6, 6e6), rng.uniform(-1e6, 6e6)) for i in range(40)] + [(90, None, 1.0), (91, float("nan"), 1.0)]
    got = {r["point_id"]: r["edge_id"] for r in spatial.snap_to_edges(spark.createDataFrame(pts, "point_id long, x double, y double"), edges).collect()}
    near = lambda x, y: min((math.hypot(x - min(1, max(0, x)), y), 1), (math.hypot(x - 5e6, y - 5e6), 2))[1]
    assert got == {i: near(x, y) for i, x, y in pts[:40]}


# --- access and surfaces raise


def test_nan_and_negative_weights_raise(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0, 1.0)], "g int, metro_d double, bus_d double, weight double")
    with pytest.raises(Exception, match="NaN"):
        access.partition_sums(df, 800, ["g"]).collect()
    bad = spark.createDataFrame([(1, -1.0), (1, 2.0)], "g int, w double")
    with pytest.raises(Exception, match="negative"):
        access.weighted_access(bad, F.col("w"), F.lit(True), ["g"]).collect()
    with pytest.raises(Exception, match="not positive"):
        bad.select(ledger.strict_pct(F.col("w"), F.lit(0.0))).collect()


# --- joins


def test_guarded_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    twice = a.unionByName(a)
    with pytest.raises(ValueError, match="repeats"):
        relate.validated(a, twice, ["k"])
    assert relate.validated(twice, a.withColumnRenamed("v", "z"), ["k"], validate="m:1").count() == 4
    with pytest.raises(ValueError, match="no metric"):
        relate.complete(a, a.where("k = 'x'").withColumnRenamed("v", "z"), ["k"], ["z"])
    assert [tuple(r) for r in relate.mismatches(a, a.where("k = 'x'"), ["k"]).collect()] == [("y", "right")]
    b = spark.createDataFrame([("X’",), ("z",)], "n string")
    with pytest.raises(ValueError, match="one side"):
        relate.keyed_both_ways(a, b, text.match_key(F.col("k")), text.match_key(F.col("n")))
    with pytest.raises(Exception, match="no code for y"):
        a.select(relate.crosswalk({"x": "1"}, F.col("k"))).collect()


def test_reconciliation_and_validation_find_faults(spark):
    a = spark.createDataFrame([(1, 10.0, 3.0, 7.0, 30.0, 500.0), (2, 10.0, 3.0, 8.0, 31.0, 900.0), (3, 0.0, 0.0, 0.0, 0.0, 100.0)], "k int, total double, p double, q double, pct double, near double")
    assert [r["k"] for r in checks.conservation_gap(a, ["p", "q"], "total").collect()] == [2]
    assert [r["k"] for r in checks.ratio_gap(a, "pct", "p", "total").collect()] == [2]
    assert sorted(r["k"] for r in checks.zero_share_gap(a, "p", "near", 800.0).collect()) == [2, 3]
    got = relate.reconciled(a, a.withColumn("total", F.col("total") + F.col("k") / 10), ["k"], ["total"], 0.25).collect()
    assert {r["k"]: r["total_ok"] for r in got} == {1: True, 2: True, 3: False}
    s = spark.createDataFrame([(2015, "a", 1.0, 1.0), (2016, "a", 2.0, 1.0), (2017, "b", 3.0, 4.0), (2018, "b", 3.0, 5.0)], "year int, state_id string, o double, f double")
    assert [r["at"] for r in checks.counterfactual_gap(s, "o", "f", "state_id", 2015).collect()] == ["b"]
    assert [r["year"] for r in checks.event_gap(spark.createDataFrame([(2016, "a")], "year int, state_id string"), s).orderBy("year").collect()] == [2016, 2017]
    assert checks.unlike_within(s, ["state_id"], ["f"]).count() == 1
    assert [tuple(r) for r in checks.implausible(a, {"pct": (0, 30.5), "k": (1, 3)}).collect()] == [("pct", 1)]
    assert [tuple(r) for r in checks.copied(a, a.withColumn("p", F.col("p").cast("string")), ["k"]).select("column").distinct().collect()] == [("p",)]
    assert checks.copied(a, a, ["k"]).count() == 0
    pos = spark.createDataFrame([(1.0, 2.0, 0.5), (3.0, 2.0, 0.5), (1.0, 2.0, 1.5), (1.0, float("inf"), 0.0)], "connector_m double, distance double, fraction double")
    assert checks.invalid_positions(pos).count() == 2


# --- elements and places


def test_elements_points_and_rings(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # a notch: the middle of the box is outside
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in ring],)], f"p array<{elements.POINT}>")
    r = df.select(elements.interior_point(F.col("p")).alias("i"), elements.ring_area(F.col("p")).alias("a"), elements.line_length(F.col("p")).alias("l"), elements.line_midpoint(F.slice("p", 1, 3)).alias("m")).first()
    assert (r["i"]["x"], r["i"]["y"]) == (pytest.approx(2 / 3), 2.0) or r["i"]["x"] == pytest.approx(10 / 3)
    assert r["a"] == 10.0 and r["l"] == pytest.approx(8 + 2 * math.sqrt(13)) and tuple(r["m"]) == (4.0, 0.0)
    raw = spark.createDataFrame([('{"type":"way","id":1,"geometry":[{"lat":0,"lon":0},{"lat":0,"lon":4},{"lat":0,"lon":0}]}',), ('{"type":"relation","id":2}',), ("nonsense",), (None,)], "j string")
    got = elements.elements(raw, "j").collect()
    assert [(x["id"], x["method"], x["x"]) for x in got] == [(1, "open_way", 4.0)]
    w = spark.createDataFrame([(1, "outer", 1, [(0.0, 0.0), (1.0, 0.0)]), (1, "outer", 2, [(1.0, 1.0), (1.0, 0.0)]), (1, "outer", 3, [(1.0, 1.0), (0.0, 0.0)]), (1, "inner", 4, [(5.0, 5.0), (6.0, 6.0)])], f"relation long, role string, way_id long, points array<{elements.POINT}>")
    rings = elements.joined_rings(w).collect()
    assert len(rings) == 1 and len(rings[0]["ring"]) == 4
    x, y = elements.projected(F.lit(69.25), F.lit(41.31), 69.24, 41.30)
    at = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert at["x"] == pytest.approx(835.4, abs=1) and at["y"] == pytest.approx(1111.9, abs=1)
    with pytest.raises(Exception, match="degrees"):
        spark.range(1).select(elements.projected(F.lit(500000.0), F.lit(41.0), 69.0, 41.0)[0]).collect()


def test_names_that_places_share_decide(spark):
    rows = [(1, 0.0, 0.0, 0, ["a", "b"]), (2, 5.0, 0.0, 1, ["b"]), (3, 6.0, 0.0, 2, ["c", "a"]), (4, 7.0, 0.0, 0, ["z"]), (5, 8.0, 0.0, 0, []), (6, None, 0.0, 0, ["a"]), (7, 300.0, 0.0, 0, ["a"])]
    p = spark.createDataFrame(rows, "place_id long, x double, y double, rank int, keys array<string>")
    got = {r["place_id"]: r["kept_id"] for r in places.dedupe_by_names(p, 10.0, ["rank", "place_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    # 2 and 3 share no name: with 1 far away both stay
    far = p.withColumn("x", F.when(F.col("place_id") == 1, 900.0).otherwise(F.col("x")))
    assert {r["place_id"]: r["kept_id"] for r in places.dedupe_by_names(far, 10.0, ["rank", "place_id"]).collect()}[3] == 3


def test_layers_and_classes(spark):
    city = sides(spark, city=SQUARE)
    two = sides(spark, west=[(0, 0), (4, 0), (4, 10), (0, 10)], east=[(6, 0), (10, 0), (10, 10), (6, 10)])
    p = spark.createDataFrame([(1, 1.0, 1.0, 0, ["a"]), (2, 1.5, 1.0, 1, ["a"]), (3, 5.0, 5.0, 0, ["b"]), (4, 50.0, 5.0, 0, ["c"])], "place_id long, x double, y double, rank int, keys array<string>")
    got = {r["place_id"]: (r["district"], r["method"]) for r in places.layer(p, two, city, 2.0, ["rank", "place_id"]).collect()}
    assert got == {1: ("west", "within"), 3: ("east", "nearest")}  # equally near: the first name
    c = p.withColumn("category", F.lit("x")).withColumn("name", F.element_at("keys", 1))
    built = {r["place_id"]: r["district"] for r in places.built_class(c, two, 2.0).collect()}
    assert built == {1: "west", 3: None, 4: None}
    tie = places.scope_counts(places.built_class(c, two, 2.0), ["category"]).first()
    assert (tie["places"], tie["within"], tie["outside"]) == (3, 1, 2)


def test_shapes_with_holes_and_tiling(spark):
    s = sides(spark, a=SQUARE).unionByName(sides(spark, a=[(4, 4), (4, 6), (6, 6), (6, 4)]))
    e = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, 1.0, 1.0, 2.0, 1.0), (3, 20.0, 0.0, 30.0, 0.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["edge_id"], round(r["length_m"], 9)) for r in shapes.inside_parts(e, s).collect())
    assert got == [(1, 4.0), (1, 4.0), (2, 1.0)]
    assert shapes.areas(s).first()["area"] == 96.0
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 1.0)], "point_id long, x double, y double")
    found = {r["rule"] for r in checks.untiled(pts, spatial.assign_polygon(pts, s), 100.0, shapes.areas(s)).collect()}
    assert found == {"inside", "cover"}


def test_ledger_rules(spark):
    t = spark.createDataFrame([("1703", 1.5), ("1704", 2.5), ("17", 4.0)], "code string, p double")
    assert sorted(tuple(r) for r in ledger.official_totals(t, "code", "p", "17").collect()) == [("1703", 1500), ("1704", 2500)]
    with pytest.raises(ValueError, match="thousand"):
        ledger.official_totals(t.withColumn("p", F.col("p") + F.length("code")), "code", "p", "17")
    with pytest.raises(ValueError, match="several rows"):
        ledger.exactly_one(t, F.col("p") > 0)
    s = spark.createDataFrame([("a", 2015, 1), ("a", 2017, 2)], "k string, year int, v int")
    assert [tuple(r) for r in ledger.year_gaps(s, ["k"]).collect()] == [("a", 2017, 2015)]
    with pytest.raises(ValueError, match="gaps"):
        ledger.latest(s, ["k"])
    assert ledger.colour_cap(s.limit(0), "v").first()[0] == 1
    assert [r[0] for r in spark.createDataFrame([(0.001,), (-1.5,), (2.0,)], "x double").select(ledger.points_text(F.col("x"))).collect()] == ["0.00 pp", "−1.50 pp", "+2.00 pp"]
    assert ledger.rounded_floats(spark.createDataFrame([(2.5, 1)], "x double, n int"), 0).first()["x"] == 2.0
    assert places.dedupe_summary(spark.createDataFrame([(1, 1, 0.0), (2, 1, 3.0)], "place_id int, kept_id int, distance double")).first()["dropped"] == 1
    assert surface.density_grid(spark.createDataFrame([(1.0, 1.0, 0)], "x double, y double, weight int")).count() == 0


# --- sources and sinks


def test_requests_repeat_and_fail_over(tmp_path):
    seen, waits = [], []

    def flaky(url, body, seconds):
        seen.append(url)
        if url == "bad" or len(seen) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return b"ok"

    assert remote.fetch("u", opener=flaky, sleep=waits.append) == b"ok" and waits == [1.0, 2.0]

    def refused(url, body, seconds):
        raise urllib.error.HTTPError(url, 404, "none", None, None)

    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("u", opener=refused, sleep=waits.append)
    assert remote.failover(["bad", "good"], b"q", opener=flaky, sleep=waits.append) == b"ok"
    q = remote.overpass_query((41.1, 69.1, 41.4, 69.4), ['["amenity"="clinic"]'], "geom")
    assert q.count("clinic") == 3 and q.endswith("out tags geom;\n")
    kept = tmp_path / "c.json"
    assert remote.cached(q, kept, lambda _: {"n": 1}) == remote.cached(q, kept, lambda _: {"n": 2}) == {"n": 1}
    with pytest.raises(ValueError, match="another query"):
        remote.cached(q + " ", kept, lambda _: {})


def test_manifest_digests_and_stable_files(tmp_path):
    m = tmp_path / "m.json"
    remote.upsert(m, "a", {"x": 1, "y": 2})
    assert remote.upsert(m, "a", {"x": 3}, keep=["y"]) == {"a": {"x": 3, "y": 2}} and remote.upsert(m, "b", {})["a"]["x"] == 3
    f = tmp_path / "t.csv"
    f.write_bytes(b"a\r\nb\r\n")
    record = remote.provenance(f, "text")
    f.write_bytes(b"a\nb\n")
    assert remote.untrue(f, record) == []
    f.write_bytes(b"a\nc\n")
    assert remote.untrue(f, record) == ["sha256"]
    f.write_bytes(b"a\rb")
    with pytest.raises(ValueError, match="CR"):
        remote.provenance(f, "text")
    assert remote.stable_gzip("x", tmp_path / "1.gz") == remote.stable_gzip("x", tmp_path / "2.gz")


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5, 2), ("010", float("nan"), 3)], "code string, x_pct double, n int")
    files.write_gzip_csv(df, str(tmp_path / "z"), ["code"])
    back = files.coded_csv(spark, str(tmp_path / "z"), ["code"], ["code"])
    assert [r["code"] for r in back.collect()] == ["007", "010"] and dict(back.dtypes)["n"] == "int"
    with pytest.raises(ValueError, match="no column"):
        files.coded_csv(spark, str(tmp_path / "z"), ["nope"])
    files.write_csv(df.limit(1), str(tmp_path / "c"), ["code"])
    assert next((tmp_path / "c").glob("*.csv")).read_bytes() == b"code,x_pct,n\n007,1.500000000,2\n"
    assert json.loads(files.web_json(df.where("n = 3")).first()[0]) == {"code": "010", "x_pct": None, "n": 3}
    cells = spark.createDataFrame([("r1", 2.0), ("r0", 1.0)], "cell_id string, w double")
    files.write_cells(cells, str(tmp_path / "p"))
    assert files.read_cells(spark, str(tmp_path / "p"), ["w"]).count() == 2
    assert files.content_digest(cells, ["cell_id"]) == files.content_digest(cells.orderBy("w"), ["cell_id"])
    for bad in (cells.unionByName(cells), cells.withColumn("cell_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="repeats"):
            files.write_cells(bad, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="lacks"):
        files.read_cells(spark, str(tmp_path / "p"), ["v"])
    meta = spark.createDataFrame([("a", 3, "u"), ("b", 3, "v")], "name string, width int, crs string")
    assert [tuple(r) for r in files.grids_differ(meta).collect()] == [("crs", 2)]


def test_geojson_features(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [(0.0000001, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], f"id int, v double, p array<{elements.POINT}>")
    for kind, coordinates in (("Point", [0.0, 0.0]), ("LineString", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), ("Polygon", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])):
        f = json.loads(files.features(df, "p", kind, role="outline").first()[0])
        assert f["geometry"] == {"type": kind, "coordinates": coordinates} and f["properties"] == {"id": 1, "v": None, "display_role": "outline"}
    out = files.collection(files.features(df, "p", "Point"), {"source": "x"})
    path = tmp_path / "d.geojson"
    path.write_text(out)
    assert json.loads(out)["provenance"] == {"source": "x"}
    read = files.geojson(spark, str(path), "id int")
    assert read.first()["geometry_type"] == "Point"
    flagged = spark.createDataFrame([(1, True, [(0.0, 0.0)]), (2, False, [(0.0, 0.0)])], f"id int, inside boolean, p array<{elements.POINT}>")
    path.write_text(files.collection(files.features(flagged, "p", "Point")))
    assert [r["id"] for r in files.districts(spark, str(path), "id int, inside boolean", "inside", 1, "id").collect()] == [1]
    with pytest.raises(ValueError, match="expected 2"):
        files.districts(spark, str(path), "id int, inside boolean", "inside", 2, "id")
    e = spark.createDataFrame([('{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0,"tags":{"a":"b"}},{"type":"node","id":1,"lat":1.0,"lon":2.0},{"type":"way","id":2}]}',)], "j string")
    assert files.tagged_elements(e, "j").count() == 1
    assert files.feature_collection(spark.createDataFrame([(1.0, 2.0, 3)], "x double, y double, n int"), "x", "y").count() == 1


def test_text_rules(spark):
    r = spark.createDataFrame([("2011-09", "month", "Mirabad district"), ("2011-13", "month", "City"), ("2011", "year", None)], "d string, p string, n string")
    assert [x[0] for x in r.select(text.date_fits(F.col("d"), F.col("p"))).collect()] == [True, False, True]
    assert [x[0] for x in r.select(text.without_suffix(F.col("n"), " district")).collect()] == ["Mirabad", "City", None]
    assert [x[0] for x in r.select(F.substring("d", 1, 4).cast("int")).collect()] == [2011] * 3
