"""Resharding by minimum-cost flow.

Old shards are the files that the rows lie in, or a column's values, dealt into a bounded number of groups. Rows
fall into blocks by old shard and a hash of their text. Copies of a text that lie in several old shards go by the
smallest of these, so equal texts share a block; a large block is cut by another hash of the text, and only a
group of equal texts that alone exceeds a new shard's capacity is cut further, by document. From the old shards'
sizes and the new shards' capacities, a minimum-cost flow (staying is free, a moved byte costs 1) says how many
bytes go from each old to each new shard; blocks are then chosen to make up these flows. Only shards that gain or
lose a block are rewritten. The plan is made of block sizes, never of rows, and its size is a parameter.
"""

from __future__ import annotations

import heapq
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch

#: Blocks of all old shards together before large ones are cut, parts of a cut block or of a group of equal texts.
BLOCKS, PARTS = 4096, 64
#: A block of more than a shard's capacity over FINE is cut: there are at most FINE * shards of them.
FINE = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow from sources to sinks that ships all supply at least cost (successive shortest paths).

    ``capacity`` must sum to the supply or more. cost(i, j) is the cost of a unit from i to j, 0 or more.
    """
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, c: int, w: int) -> None:
        graph[u].append([v, c, w, len(graph[v])])
        graph[v].append([u, 0, -w, len(graph[u]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    potential = [0] * len(graph)
    while True:
        dist, back = [float("inf")] * len(graph), [None] * len(graph)
        dist[s], queue = 0, [(0, s)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for k, (v, c, w, _) in enumerate(graph[u]):
                if c > 0 and (nd := d + w + potential[u] - potential[v]) < dist[v]:
                    dist[v], back[v] = nd, (u, k)
                    heapq.heappush(queue, (nd, v))
        if back[t] is None:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        path, v = [], t
        while v != s:
            path.append(back[v])
            v = back[v][0]
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            e = graph[u][k]
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1] > 0}


def assign(blocks: list[tuple], shards: int, old_shards: int) -> tuple[dict, int, int]:
    """(block -> new shard, bytes that the flow moves, bytes that the blocks move).

    ``blocks`` are (block, old shard, bytes). Capacities are equal to a byte. Every old shard deals its
    blocks, largest first, to the flow with most left to make up; flows are whole bytes and blocks are
    not, so what remains is evened out: the smallest fitting block goes from the fullest shard to the
    emptiest as long as this narrows the gap.
    """
    total = sum(b[2] for b in blocks)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    supply = [0] * old_shards
    for _, old, size in blocks:
        supply[old] += size
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    place, load = {}, [0] * shards
    for i in range(old_shards):
        own = sorted((b for b in blocks if b[1] == i), key=lambda b: (-b[2], b[0]))
        left = {j: f for (a, j), f in sorted(flow.items()) if a == i} or {i if i < shards else 0: 0}
        for key, _, size in own:
            j = max(left, key=lambda j: (left[j], j == i, -j))
            left[j] -= size
            place[key] = j
            load[j] += size
    size_of = {b[0]: b[2] for b in blocks}
    members = [sorted((size_of[k], k) for k, j in place.items() if j == s) for s in range(shards)]
    for _ in range(64 * shards):
        hi, lo = max(range(shards), key=lambda j: (load[j], -j)), min(range(shards), key=lambda j: (load[j], j))
        gap = load[hi] - load[lo]
        fits = [x for x in members[hi] if 0 < x[0] < gap]
        if not fits:
            break
        x = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        members[hi].remove(x)
        members[lo] = sorted([*members[lo], x])
        place[x[1]] = lo
        load[hi] -= x[0]
        load[lo] += x[0]
    moved = sum(size for key, old, size in blocks if place[key] != old)
    return place, sum(f for (i, j), f in flow.items() if i != j), moved


def _old(docs: DataFrame, old_shard: str | None, groups: int):
    """Column expression: the old shard of a row, 0 to groups - 1."""
    if old_shard is not None:
        name = F.col(f"`{old_shard}`").cast("string")
        number = F.expr(f"try_cast(`{old_shard}` AS BIGINT)")
        # small numbers are shards themselves, so that shard j can stay shard j
        return F.when(number.between(0, groups - 1), number).otherwise(F.pmod(F.xxhash64(name), F.lit(groups))).cast("int")
    files = sorted(f.rpartition("/")[2] for f in docs.inputFiles())
    file = F.substring_index(F.input_file_name(), "/", -1)
    if 0 < len(files) <= groups:  # in order of their names: file j may stay shard j
        at = F.array_position(F.array(*map(F.lit, files)), file).cast("int")
        return F.greatest(at - 1, F.lit(0))
    return F.pmod(F.xxhash64(file), F.lit(groups)).cast("int")


def _one_source(docs: DataFrame) -> bool:
    """Whether the rows' files can be told: they are read from one place."""
    try:
        return docs.select(F.input_file_name()).columns is not None and len(docs.inputFiles()) > 0
    except AnalysisException:
        return False


def _planned(docs: DataFrame, row, text: str, doc_id: str, shards: int, old_shards: int, blocks: int, old_shard: str | None) -> tuple[DataFrame, dict]:
    """(``row`` with size, old, shard and slot; bytes of old shards, bytes that the flow and the blocks move)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    if old_shard is None and not _one_source(docs):
        names = docs.columns  # written under names that Parquet takes
        docs = scratch.keep(docs.toDF(*[f"c{i}" for i in range(len(names))])).toDF(*names)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = (F.octet_length(t) + 1).cast("long")
    rows = docs.select(row.alias("row"), F.col(f"`{doc_id}`").cast("string").alias("id"), size.alias("size"), _old(docs, old_shard, old_shards).alias("old"), F.xxhash64(t).alias("h"))
    # texts that lie in several old shards belong to the first of them
    homes = rows.groupBy("h").agg(F.min("old").alias("home"), F.max("old").alias("last")).where("home <> last").select("h", "home")
    homes = scratch.keep(homes)
    if homes.limit(1).count():
        rows = rows.join(homes.hint("merge"), "h", "left").withColumn("home", F.coalesce("home", "old"))
    else:
        rows = rows.withColumn("home", F.col("old"))
    block = F.pmod("h", F.lit(max(1, blocks // old_shards))).cast("int")
    part = F.pmod(F.xxhash64(F.lit(17), "h"), F.lit(PARTS)).cast("int")
    piece = F.pmod(F.xxhash64(F.lit(23), "id", "h"), F.lit(PARTS)).cast("int")

    def keyed(heavy: list[tuple], whole: list[tuple]) -> DataFrame:
        one = lambda cells, *cs: reduce(or_, [reduce(and_, [F.col(c) == v for c, v in zip(cs, cell, strict=True)]) for cell in cells], F.lit(False))
        out = rows.withColumn("block", block)
        out = out.withColumn("part", F.when(one(heavy, "home", "block"), part).otherwise(F.lit(0)))
        return out.withColumn("piece", F.when(one(whole, "home", "block", "part"), piece).otherwise(F.lit(0)))

    def cells(heavy: list[tuple], whole: list[tuple]) -> list:
        return keyed(heavy, whole).groupBy("home", "block", "part", "piece").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()

    found = cells([], [])
    capacity = sum(r["s"] for r in found) / shards
    heavy, pieced = sorted((r["home"], r["block"]) for r in found if r["s"] > capacity / FINE), []
    if heavy:
        found = cells(heavy, [])
        pieced = sorted((r["home"], r["block"], r["part"]) for r in found if r["s"] > capacity / FINE)
    # large parts are numbered in pieces; the pieces stay together unless the part alone exceeds a shard's capacity
    apart = {(r["home"], r["block"], r["part"]) for r in found if r["s"] > capacity}
    if pieced:
        found = cells(heavy, pieced)
    rows_of = sorted(((r["home"], r["block"], r["part"], r["piece"]), r["s"], r["n"]) for r in found)
    unit = lambda cell: cell if cell[:3] in apart else cell[:3]
    sizes: dict[tuple, int] = {}
    for cell, s, _ in rows_of:
        sizes[unit(cell)] = sizes.get(unit(cell), 0) + s
    place, flow, moved = assign([(u, u[0], s) for u, s in sorted(sizes.items())], shards, old_shards)
    offset, plan = [0] * shards, []
    for cell, _, n in rows_of:
        j = place[unit(cell)]
        plan.append((*cell, j, offset[j]))
        offset[j] += n
    planned = spark.createDataFrame(plan, "home int, block int, part int, piece int, shard int, offset long")
    # at most BLOCKS + 2 * FINE * shards * PARTS rows of 28 bytes
    cell = ["home", "block", "part", "piece"]
    out = keyed(heavy, pieced).join(F.broadcast(planned), cell)
    slot = (F.col("offset") + F.row_number().over(Window.partitionBy(*cell).orderBy("id", "h", "size")) - 1).cast("long")
    facts = {"flow": flow, "moved": moved, "units": len(sizes)}
    return out.select("row", F.struct("size", "old", "shard", slot.alias("slot")).alias("plan")), facts


RESULTS = ("size", "old_shard", "shard", "slot")


def reshard(docs: DataFrame, keep: list[str], shards: int = 8, old_shards: int = 8, blocks: int = BLOCKS, old_shard: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``keep`` columns of every row plus size, old_shard, shard and slot.

    size is the UTF-8 bytes of ``text`` plus 1; a null text has none. Old shards are the values of the column
    ``old_shard`` (0 to old_shards - 1; others by hash), else the input files (more than ``old_shards`` of them are
    dealt into so many groups by hash; a table that isn't read from one place is written first). slot counts from 0 in each shard without
    gaps; rows are numbered by id as text, null first, and text hash within their block. Rows with equal texts share a
    shard, unless they alone exceed a shard's share. New shards are as near to equal size as whole blocks allow;
    one document longer than a shard's share, or rows that repeat one id and text, are not cut. Empty table: no
    rows. A kept column that has the name of a result column is left out.
    """
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    out, _ = _planned(docs, row, text, doc_id, shards, old_shards, blocks, old_shard)
    named = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in RESULTS]
    return out.select(*named, "plan.size", F.col("plan.old").alias("old_shard"), "plan.shard", "plan.slot")


def rewrite(docs: DataFrame, path: str, shards: int = 8, old_shards: int = 8, blocks: int = BLOCKS, old_shard: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the shards that gain or lose a row as ``path``/shard=N, and returns one row for each shard.

    Result: shard, rows, bytes, gained and lost (bytes that come and go), written. Shards with neither stay as
    they are and are not written. Columns go as they are (one named ``shard`` would clash with the folder's and goes
    as ``shard_in``); an empty table writes nothing.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    planned, _ = _planned(docs, row, text, doc_id, shards, old_shards, blocks, old_shard)
    planned = Scratch(docs.sparkSession).keep(planned)
    flat = planned.select("plan.*")
    into = flat.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("old") != F.col("shard"), F.col("size")).otherwise(0)).alias("gained"))
    away = flat.where(f"old <> shard AND old < {shards}").groupBy(F.col("old").alias("shard")).agg(F.sum("size").alias("lost"))
    facts = into.join(away, "shard", "full").fillna(0)
    facts = facts.withColumn("written", (F.col("gained") > 0) | (F.col("lost") > 0))
    touched = [r["shard"] for r in facts.where("written").select("shard").collect()]  # no more than there are shards
    named = [F.col(f"row.c{i}").alias("shard_in" if c.lower() == "shard" else c) for i, c in enumerate(docs.columns)]
    out = planned.where(F.col("plan.shard").isin(touched)).select(*named, F.col("plan.shard").alias("shard"))
    out.write.partitionBy("shard").mode("overwrite").parquet(path)
    return facts
