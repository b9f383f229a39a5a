"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks by a hash of their id; each block keeps one sorted list per dimension.
A query walks the lists of its non-zero dimensions from the end that helps it: from the top where its
component is positive, from the bottom where it is negative, in steps, first the lists whose next entry
contributes most. What it meets is scored exactly, and the threshold, the best score that an unmet vector
could have (the sum of what the lists' next entries contribute), falls with every step. The walk ends when
the kth score is above the threshold (a tie goes on: an unmet vector may have a smaller id), or when the
lists have shown every vector. There is no other way to a result, whatever the sizes.

Walks run per (query block, vector block) pair; the k best of each pair meet in one aggregation of at most
k rows for each query and block. Vectors and queries are shuffled in blocks, nothing is broadcast, and a
task holds one block of each. How far the walks went is in the result: scored and stopped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors, and of a block of queries: what one task holds.
BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Entries that a list gives in one step: the block's rows over STEPS, and STEP at least. Lists of a step: one in TURN.
STEPS, STEP, TURN = 128, 4, 4
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component, x as double, held to the range of a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and all components finite and not null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(vectors: list, dims: int, exact: bool) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=object if exact else np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v] if exact else v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        # everything at or above the kth score, ties included
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Lists:
    """A block's sorted lists, one for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.place = {int(i): j for j, i in enumerate(ids)}

    def walk(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
        """(positions, scores, vectors scored, stopped by the threshold) of the k best for one query."""
        n, dims = len(self.ids), np.flatnonzero(query != 0)
        up = query[dims] > 0
        seen = np.zeros(n, dtype=bool)
        mine = self.place.get(int(own))
        if mine is not None:
            seen[mine] = True  # the query's own vector is never its answer
        best, scores, scored = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.vectors.dtype), 0
        depth = np.zeros(len(dims), dtype=np.int64)
        step = np.arange(max(STEP, n // STEPS))
        turn = max(1, len(dims) // TURN)

        def entry(at: np.ndarray, d: np.ndarray) -> np.ndarray:
            """Vectors that lists ``d`` show at places ``at`` of their walks."""
            return self.order[np.where(up[d], n - 1 - at, at), dims[d]]

        while True:
            open_ = np.flatnonzero(depth < n)
            if len(dims) and not len(open_) or seen.all():
                return best, scores, scored, False
            if len(dims):
                every = np.arange(len(dims))
                ahead = query[dims] * self.vectors[entry(np.minimum(depth, n - 1), every), dims]
                if len(best) == k and scores[-1] > ahead.sum():
                    return best, scores, scored, True
                chosen = open_[np.argsort(-ahead[open_], kind="stable")[:turn]]
                at = depth[chosen][:, None] + step[None, :]
                met = np.unique(entry(np.minimum(at, n - 1).ravel(), np.repeat(chosen, len(step))))
                depth[chosen] = np.minimum(depth[chosen] + len(step), n)
                met = met[~seen[met]]
            else:
                met = np.flatnonzero(~seen)  # a query of zeros has no list: every score is 0
            if not len(met):
                continue
            seen[met] = True
            scored += len(met)
            best, scores = np.concatenate([best, met]), np.concatenate([scores, self.vectors[met] @ query])
            chosen = _best(scores, self.ids[best], k)
            best, scores = best[chosen], scores[chosen]


def threshold_search(q_ids, queries, ids, vectors, k: int) -> list[tuple]:
    """(query, vector, score, vectors scored, stopped) of the k best in this block for each query, its own id left out.

    The inputs are id arrays and lists of integer vectors; a shorter vector counts as ending in zeros.
    Scores are computed in float64 where the largest possible product sum is below 2^53, else in
    unbounded integers held to the range of a long.
    """
    q_ids, ids = np.asarray(q_ids, dtype=np.int64), np.asarray(ids, dtype=np.int64)
    dims = max([len(v) for v in (*queries, *vectors)], default=0)
    top = lambda vs: max((max(int(max(v)), -int(min(v))) for v in vs if len(v)), default=0)
    exact = top(queries) * top(vectors) * max(dims, 1) >= 2**53
    Q, out = _matrix(queries, dims, exact), []
    if not len(ids) or not len(q_ids):
        return out
    lists = Lists(ids, _matrix(vectors, dims, exact))
    for own, query in zip(q_ids, Q, strict=True):
        best, scores, scored, stopped = lists.walk(own, query, k)
        out += [(own, ids[j], max(-LONG - 1, min(LONG, int(s))), scored, stopped) for j, s in zip(best, scores, strict=True)]
    return out


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k best vectors by integer inner product for each query.

    ``vectors`` and ``queries`` hold ``id`` (long) and ``v`` (array of long); other columns are ignored.
    Result: query_id, rank (from 1), vec_id, score, scored (vectors that the query's walks scored, in the
    blocks that gave an answer) and stopped (walks among them that the threshold ended); fewer than k rows
    where there are fewer others; none for an empty table. Ties go to the smaller vec_id. Rows with a null id
    or vector take no part. Of rows that repeat an id, the smallest vector counts, once. The query's own id is
    never its answer.
    """
    one = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    vectors, queries = one(vectors), one(queries)
    n, m = vectors.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    # every pair of blocks is one group: each side is copied once for every block of the other side
    side = lambda df, own, other, count: df.select(
        "id", "v", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other"),
    )
    left = side(queries, q_blocks, blocks, blocks).select("id", "v", F.col("own").alias("qb"), F.col("other").alias("vb"))
    right = side(vectors, blocks, q_blocks, q_blocks).select(F.col("id").alias("vid"), "v", F.col("other").alias("qb"), F.col("own").alias("vb"))

    def search(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = threshold_search(q["id"], list(q["v"]), c["vid"], list(c["v"]), k) if len(q) and len(c) else []
        out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "s", "e"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "s": "int64", "e": bool})
        return out.assign(b=int(key[1]))

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(search, "query_id long, vec_id long, score long, s long, e boolean, b int")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a walk's figures stand on each of its rows: they count once, on the block's first row
    first = F.row_number().over(Window.partitionBy("query_id", "b").orderBy(F.desc("score"), "vec_id")) == 1
    every = Window.partitionBy("query_id")
    ranked = found.withColumn("first", first).withColumn("rank", F.row_number().over(by))
    ranked = ranked.withColumn("scored", F.sum(F.when(F.col("first"), F.col("s"))).over(every)).withColumn("stopped", F.count_if(F.col("first") & F.col("e")).over(every))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored", "stopped")
