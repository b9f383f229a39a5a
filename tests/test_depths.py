"""Numbers of polygons on both sides, pairs of polygons and long rings against the overlay by names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netaccess.operators import lineage, overlay


def sides_of(spark, polygons):
    rows = [(la, n, *map(float, (*a, *b))) for la, n, r in polygons for a, b in zip(r, r[1:] + r[:1], strict=True)]
    return spark.createDataFrame(rows, "layer string, name string, x1 double, y1 double, x2 double, y2 double")


def test_depths_and_pairs_equal_the_overlay_by_names(spark):
    rng = random.Random(11)
    free = [("free", f"t{i}", [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(4)]) for i in range(12)]
    # whole numbers: sides on each other, corners on sides, level sides, polygons that cross themselves
    tight = [("tight", f"g{i}", [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(4)]) for i in range(25)]
    ring = [("ring", "r", [(0, 0), (9, 0), (9, 9), (0, 9)]), ("ring", "r", [(3, 3), (6, 3), (6, 6), (3, 6)]), ("ring", "fill", [(3, 3), (6, 3), (6, 6), (3, 6)]), ("ring", "again", [(3, 3), (6, 3), (6, 6), (3, 6)])]
    sides = overlay.cut(sides_of(spark, free + tight + ring))
    named = overlay.cut(overlay.faces(sides))
    outlines = overlay.cut(overlay.oriented(sides))
    got = overlay.cut(overlay.depths(outlines, F.col("name").isin("t3", "g4", "fill")))
    layers = lambda df: {r["layer"]: r["area"] for r in df.collect()}
    for n in range(1, 5):
        assert layers(overlay.area_where(got, lambda c, n=n: c["n"] >= n)) == pytest.approx({la: a for la, a in layers(overlay.area_where(named, lambda c, n=n: F.size(c) >= n)).items()}, abs=1e-4)
    has = lambda c: F.arrays_overlap(c, F.array(F.lit("t3"), F.lit("g4"), F.lit("fill")))
    rest = layers(overlay.area_where(named, lambda c: (F.size(c) > 0) & ~has(c)))
    assert layers(overlay.area_where(got, lambda c: (c["n"] > 0) & (c["marked"] == 0))) == pytest.approx(rest, abs=1e-4)
    assert rest["ring"] == pytest.approx(72.0)
    pairs = lambda df: {(r["layer"], r["a"], r["b"]): r["area"] for r in df.where("area > 1e-4").collect()}
    assert pairs(overlay.pair_overlaps(outlines)) == pytest.approx(pairs(overlay.overlaps(named)), abs=1e-4)
    own = {(r["layer"], r["name"]): r["area"] for r in overlay.areas(named).where("abs(area) > 1e-9").collect()}
    assert {(r["layer"], r["name"]): r["area"] for r in overlay.outline_areas(outlines).collect()} == pytest.approx(own, abs=1e-4)
    rings = overlay.linked(overlay.outline(got.where("layer <> 'free'"), lambda c: c["n"] > 0))
    assert layers(rings.groupBy("layer").agg(F.sum("area").alias("area"))) == pytest.approx({la: a for la, a in layers(overlay.area_where(named)).items() if la != "free"}, abs=1e-4)


def test_a_piece_under_many_polygons_stays_a_short_row(spark):
    boxes = [("all", f"b{i:03}", [(i / 10, i / 10), (50 + i / 10, i / 10), (50 + i / 10, 50 + i / 10), (i / 10, 50 + i / 10)]) for i in range(60)]
    got = overlay.cut(overlay.depths(overlay.oriented(sides_of(spark, boxes))))
    assert got.agg(F.max("left.n")).first()[0] == 60 and dict(got.dtypes)["left"] == "struct<n:bigint,marked:bigint>"
    assert overlay.area_where(got, lambda c: c["n"] == 60).first()["area"] == pytest.approx((50 - 5.9) ** 2)


def test_rounds_of_joins_dont_multiply_the_estimate(spark):
    df = spark.range(50).select("id", ((F.col("id") + 1) % 50).alias("hop"))
    began = time.perf_counter()
    for _ in range(27):  # with checkpoints the estimate doubles its digits each round
        df = lineage.written(df.join(df.select(F.col("id").alias("hop"), F.col("hop").alias("hop2")), "hop").select("id", F.col("hop2").alias("hop")))
    assert df.count() == 50 and time.perf_counter() - began < 90
