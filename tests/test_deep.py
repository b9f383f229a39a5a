"""Crowded layers: unions and differences follow what lies open, not the pairs of polygons; convex outlines are taken as they are."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_depths import sides_of

from netaccess.operators import overlay
from netaccess.plans import catalogue, catalogue_shapes  # noqa: F401


@pytest.fixture
def crowd(spark, tmp_path):
    """A folder with a table of 1,500 vectors in one layer on 80 m, and the grid of how many diamonds cover each unit of u = x + y, v = x - y."""
    rng = random.Random(5)
    rows = [(i, 4, [rng.randint(-40, 40) / 1000, rng.randint(-40, 40) / 1000, *[0.0] * 6]) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    grid, own = np.zeros((400, 400), int), []
    for i, _, e in rows:
        a, c = round(e[0] * 1000), round(e[1] * 1000)
        u, v, w, h = a + c + 150, a - c + 150, 20 + 2 * (i % 30), 30 + 2 * (i % 20)
        grid[u : u + w, v : v + h] += 1
        own.append(w * h / 2)
    return str(tmp_path), grid, own


@pytest.fixture
def meetings(monkeypatch, tmp_path):
    """Pairs of sides that were worked out so far."""
    work, keep = tmp_path / "pairs", overlay._changes
    work.mkdir()

    def counting(*args):
        run, to = keep(*args), str(work)

        def counted(batches):
            def seen():
                for rows in batches:
                    with open(f"{to}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(len(rows)))
                    yield rows

            yield from run(seen())

        return counted

    monkeypatch.setattr(overlay, "_changes", counting)
    return lambda: sum(int(p.read_text()) for p in work.iterdir())


def test_union_of_a_crowd_works_on_its_rim(spark, crowd, meetings):
    folder, grid, own = crowd
    got = catalogue.QUERIES["polygon_union"](spark, folder).collect()
    assert [tuple(r) for r in got] == [(4, (grid > 0).sum() / 2, (grid == 1).sum() / 2, (grid > 1).sum() / 2, sum(own))]
    assert grid.max() > 200 and 0 < meetings() < 300_000


def test_difference_of_a_crowd_works_on_its_rim(spark, crowd, meetings):
    folder, grid, own = crowd
    got = catalogue.QUERIES["polygon_difference"](spark, folder).collect()
    assert [tuple(r) for r in got] == [(4, (grid > 0).sum() / 2 - own[0])]
    assert 0 < meetings() < 300_000


def test_deep_pieces_alone_are_left_out(spark):
    rng = random.Random(3)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    # whole numbers and sides at 45 degrees, so that sides meet grid cells and each other in simple places
    boxes = [("b", f"p{i}", box(rng.randint(0, 20), rng.randint(0, 20), rng.randint(4, 12), rng.randint(4, 12))) for i in range(30)]
    skew = [("s", f"p{i}", [(x, y), (x + a, y + a), (x + a - b, y + a + b), (x - b, y + b)]) for i in range(40) for x, y, a, b in [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(2, 8), rng.randint(2, 8))]]
    free = [("f", f"p{i}", [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3)]) for i in range(40)]
    outlines = overlay.cut(overlay.oriented(sides_of(spark, boxes + skew + free)))
    mark = F.col("name") == "p7"
    every = overlay.cut(overlay.depths(outlines, mark))
    named = overlay.cut(overlay.faces(outlines))
    layers = lambda df: {r["layer"]: r["area"] for r in df.collect()}
    for n in (1, 2, 5):
        assert layers(overlay.area_where(every, lambda c, n=n: c["n"] >= n)) == pytest.approx(layers(overlay.area_where(named, lambda c, n=n: F.size(c) >= n)), abs=1e-3)
    least = F.least("left.n", "right.n")
    for deep in (1, 2, 4):
        some = overlay.depths(outlines, mark, deep).select("*")
        want = every.where((least < deep) | (F.col("left.marked") != F.col("right.marked")))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) and want.count() < every.count()


def test_outlines_of_convex_polygons_and_others(spark):
    shapes = {
        "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "turned": [(0, 0), (0, 4), (4, 4), (4, 0)], "corner": [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)],
        "bow": [(0, 0), (4, 4), (4, 0), (0, 4)], "vertex on a side": [(0, 0), (2, 0), (4, 0), (4, 4)], "long": [(10 * np.cos(i / 20 * np.pi), 10 * np.sin(i / 20 * np.pi)) for i in range(40)],
        "twice": [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)],
    }
    hole = [("a", "hole", shapes["square"]), ("a", "hole", [(1, 1), (2, 1), (2, 2), (1, 2)])]
    sides = sides_of(spark, [("a", n, r) for n, r in shapes.items()] + hole)
    got = overlay.cut(overlay.oriented(sides))
    alone = sides.select(F.struct("layer", "name").alias("layer"), F.lit("").alias("name"), *overlay.ENDS)
    want = overlay.outline(overlay.faces(alone)).select("layer.layer", "layer.name", *overlay.ENDS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    convex = {r["name"] for r in overlay._convex(overlay._upward(sides)).where("convex").collect()}
    assert convex == {"square", "turned"}
    areas = {r["name"]: r["area"] for r in overlay.outline_areas(got).collect()}
    assert areas["turned"] == 16 and areas["corner"] == 12 and areas["bow"] == 8 and areas["hole"] == 15 and "twice" not in areas
