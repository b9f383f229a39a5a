"""Plain Lloyd clustering of integer vectors.

The centroids (k of a fixed dimension, so of bounded size) go to every task. Tasks compute integer squared differences
to each centroid in NumPy, argmin takes the lowest number among equals, and each partition returns one row of
integer sums for each of its clusters; the rows merge through groupBy, and the driver divides k sums. Vectors never
move: the quantised table is written once, and each round reads it again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch
from netaccess.llm.topk import quantised, usable

LONG = 2**63 - 1


def _matrix(vectors: list, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in 64 bits where that is exact, else in unbounded integers."""
    x, c = np.array([np.asarray(v) for v in vectors], dtype=np.int64), np.array(centroids, dtype=object)
    top = max((max(int(m.max()), -int(m.min())) for m in (x, c) if m.size), default=0)
    return (x, c.astype(np.int64)) if 4 * top * top * max(1, c.shape[1]) <= LONG else (x.astype(object), c)


def nearest(vectors: list, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as a matrix, number of the nearest centroid, squared distance to it); ties to the smaller number."""
    x, c = _matrix(vectors, centroids)
    distance = np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)
    best = distance.argmin(1) if distance.dtype != object else np.array([min(range(len(c)), key=lambda j: (d[j], j)) for d in distance], dtype=np.int64)
    return x, best, distance[np.arange(len(x)), best]


def _sums(centroids: list[list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = [0] * len(centroids), [np.zeros(len(c), dtype=object) for c in centroids]
        for pdf in batches:
            if not len(pdf):
                continue
            x, best, _ = nearest(list(pdf["v"]), centroids)
            for j in np.unique(best):
                mine = x[best == j]
                count[j] += len(mine)
                total[j] = total[j] + mine.sum(0).astype(object)
        rows = [(j, p, Decimal(int(s)), count[j]) for j, sums in enumerate(total) if count[j] for p, s in enumerate(sums)]
        yield pd.DataFrame(rows, columns=["cluster", "pos", "s", "n"])

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, best, distance = nearest(list(pdf["v"]), centroids)
                yield pd.DataFrame({"id": pdf["id"], "cluster": best.astype(np.int32), "distance": [min(LONG, int(d)) for d in distance]})

    return run


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each kept vector: id (named as ``vec_id``), cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or not finite; a component x counts as floor(scale * x),
    x as double, held to the range of a long. The first centroids are the k kept vectors with the smallest
    sha256 of ``seed:id``; equal ids go by vector, rows without an id come last. Each round assigns every
    vector to its nearest centroid (ties to the smaller number) and replaces each non-empty centroid by its vectors'
    floor(sum / count) per component. Repeated rows count each; with fewer rows than k there are fewer centroids, an
    empty table gives an empty result. distance and both inertias are held to the range of a long. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col(f"`{vector}`")
    kept = vectors.where(usable(v) & (F.size(v) == dims))
    kept = scratch.keep(kept.select(F.col(f"`{vec_id}`").alias("id"), quantised(v, scale).alias("v")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = [[int(x) for x in r["v"]] for r in starts]
    names = f"`{vec_id}` {kept.schema['id'].dataType.simpleString()}"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"{names}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = kept.mapInPandas(_sums(centroids), "cluster int, pos int, s decimal(38,0), n long")
        merged = sums.groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # k * dims rows
        for r in merged:
            centroids[r["cluster"]][r["pos"]] = int(r["s"]) // r["n"]
    out = scratch.keep(kept.mapInPandas(_assigned(centroids), f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def of_cluster(values: dict[int, object]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("cluster"))

    sha = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}
    mine = of_cluster({j: min(LONG, inertia.get(j, 0)) for j in sha}).cast("long")
    return out.select(
        F.col("id").alias(vec_id), "cluster", "distance", mine.alias("cluster_inertia"),
        F.lit(min(LONG, sum(inertia.values()))).cast("long").alias("inertia"), of_cluster(sha).alias("centroid_sha256"),
    )
