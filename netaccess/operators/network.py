"""Edges, statistics, components, splicing of sources, shortest paths and service areas."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators.lineage import cut, dealt
from netaccess.operators.quantiles import exact_quantiles

#: Positions on an edge closer than this are one, in metres.
EPSILON = 1e-6
#: Edges of the largest network that one worker searches; beyond it the distributed search is used.
WORKER_EDGES = 100_000
#: Width of a distance bucket of the distributed search, in mean edges.
BUCKET_EDGES = 8.0
#: Directed edges of a task of the distributed search, about.
TASK_EDGES = 100_000


def canonical_edges(records: DataFrame) -> DataFrame:
    """Directed records (u, v, cost) to undirected edges: ordered ends, equal costs merged and counted, numbered.

    Records without a positive finite cost are dropped; parallel edges of different cost stay apart. The
    number orders the edges by (u, v, cost): by ranges of u, so that no task holds all edges.
    """
    good = records.where("u IS NOT NULL AND v IS NOT NULL AND cost > 0 AND NOT isnan(cost) AND cost < double('inf')")
    ends = good.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("cost"), F.round("cost", 6).alias("c"))
    edges = ends.groupBy("u", "v", "c").agg(F.min("cost").alias("cost_m"), F.count("*").alias("records"))
    # number within u, and offsets by u from counts: windows hold one node's edges, and one row for each bucket of nodes
    within = F.row_number().over(Window.partitionBy("u").orderBy("v", "c"))
    counts = edges.groupBy("u").count()
    bucket = F.floor(F.col("u") / 1024)
    totals = counts.groupBy(bucket.alias("bk")).agg(F.sum("count").alias("n"))
    before = totals.select("bk", (F.sum("n").over(Window.orderBy("bk")) - F.col("n")).alias("base"))
    inside = counts.withColumn("bk", bucket).withColumn("off", F.sum("count").over(Window.partitionBy("bk").orderBy("u")) - F.col("count"))
    offsets = inside.join(before, "bk").select("u", (F.col("off") + F.col("base")).alias("off"))
    out = edges.withColumn("i", within).join(offsets, "u")
    return out.select((F.col("off") + F.col("i") - 1).cast("long").alias("edge_id"), "u", "v", "cost_m", "records")


def reversed_line(wkt):
    """A LINESTRING text with its points the other way round; no number is parsed."""
    inner = F.regexp_extract(wkt, r"\((.*)\)", 1)
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.reverse(F.split(inner, r"\s*,\s*")), ", "), F.lit(")"))


def canonical_lines(records: DataFrame) -> DataFrame:
    """``canonical_edges`` for records with a line (u, v, cost, wkt): one edge for each ends, cost and line.

    The line is turned with its ends; a loop's line is the smaller of itself and its reverse. Columns: u, v, cost_m, wkt, records.
    """
    good = records.where("u IS NOT NULL AND v IS NOT NULL AND cost > 0 AND NOT isnan(cost) AND cost < double('inf')")
    back = reversed_line(F.col("wkt"))
    line = F.when(F.col("u") < F.col("v"), F.col("wkt")).when(F.col("u") > F.col("v"), back).otherwise(F.least(F.col("wkt"), back))
    ends = good.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost", F.bround("cost", 6).alias("c"), line.alias("wkt"))
    return ends.groupBy("u", "v", "c", "wkt").agg(F.min("cost").alias("cost_m"), F.count("*").alias("records")).drop("c")


def guarded(df: DataFrame, expected: int | None, what: str) -> DataFrame:
    """The table, after its number of rows was compared with what is expected."""
    n = df.count() if expected is not None else None
    if n != expected:
        raise ValueError(f"{n} {what}, expected {expected}")
    return df


def backing_histogram(edges: DataFrame) -> DataFrame:
    """How many edges are made of how many records: records, edges."""
    return edges.groupBy("records").agg(F.count("*").alias("edges"))


def spliced_xy(spliced: DataFrame, lines: DataFrame) -> DataFrame:
    """(mode, node, x, y) of the nodes that splicing adds, interpolated along their straight edges."""
    new = spliced.where("fraction > 0 AND fraction < 1").select("mode", "edge_id", "node", "fraction").distinct()
    f = F.col("fraction")
    at = lines.select("edge_id", "x1", "y1", "x2", "y2")
    return new.join(at, "edge_id").select("mode", "node", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y"))


def snap_subset(snaps: DataFrame, active: DataFrame, key: str = "point_id") -> DataFrame:
    """The snaps of the active sources, not computed anew."""
    return snaps.join(active.select(key).distinct(), key, "left_semi")


def cheapest_pairs(edges: DataFrame) -> DataFrame:
    """Parallel edges collapse to the cheapest, never to a sum; loops go."""
    return edges.where("u <> v").groupBy("u", "v").agg(F.min("cost_m").alias("cost_m"))


def network_stats(edges: DataFrame, budget: float) -> DataFrame:
    pairs = edges.groupBy("u", "v").agg(F.count("*").alias("m"))
    a = edges.agg(
        F.count("*").alias("edges"), F.sum("records").alias("records"), F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count_if(F.col("records") > 1).alias("merged"),
        F.round(F.min("cost_m"), 4).alias("min_cost"), F.round(F.max("cost_m"), 4).alias("max_cost"), F.count_if(F.col("cost_m") > budget).alias("over_budget"),
    )
    b = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("m") > 1).alias("parallel_pairs"), F.max("m").alias("most_parallel"))
    median = exact_quantiles(edges, "cost_m", [0.5], []).select(F.round(F.col("q")[0], 4).alias("median_cost"))
    return a.crossJoin(F.broadcast(b)).join(F.broadcast(median), how="left")  # one row each


def splice(edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Breaks (mode, edge_id, fraction, node, cost_m) of every edge that has a source, and source nodes.

    ``snaps``: mode, point_id, edge_id, fraction, connector_m. Positions within EPSILON metres of the last
    kept one, or of an end, are merged with it, in order of fraction; so an edge's sources are walked
    in order, edge by edge. Edge ends are 0 and 1. Node names: "n<id>" for network nodes and
    "s<edge>:<k>" for spliced ones. Returns (mode, edge_id, fraction, node, connector_m), connector_m only
    where a source enters.
    """
    rows = snaps.join(edges.select("edge_id", "u", "v", "cost_m"), "edge_id")
    # an edge is a row, as a call for each of many edges costs more than the walk; dealt to all cores, as Spark would take the few bytes for one
    each = rows.groupBy("mode", "edge_id", "u", "v", "cost_m").agg(F.sort_array(F.collect_list(F.struct("fraction", "point_id", "connector_m"))).alias("at"))
    each = each.repartition(each.sparkSession.sparkContext.defaultParallelism)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mode, edge, un, vn, cost, sources in zip(pdf["mode"], pdf["edge_id"], pdf["u"], pdf["v"], pdf["cost_m"], pdf["at"], strict=True):
                u, v = f"n{un}", f"n{vn}"
                out += [(mode, edge, 0.0, u, None), (mode, edge, 1.0, v, None)]
                kept, node, k = None, None, 0
                for source in sources:
                    pos, con = source["fraction"] * cost, source["connector_m"]
                    if pos <= EPSILON:
                        out.append((mode, edge, 0.0, u, con))
                    elif cost - pos <= EPSILON:
                        out.append((mode, edge, 1.0, v, con))
                    else:
                        if kept is None or pos - kept > EPSILON:
                            kept, node = pos, f"s{edge}:{k}"
                            k += 1
                        out.append((mode, edge, kept / cost, node, con))
            yield pd.DataFrame(out, columns=["mode", "edge_id", "fraction", "node", "connector_m"])

    return each.mapInPandas(walk, "mode string, edge_id long, fraction double, node string, connector_m double")


def break_table(edges: DataFrame, spliced: DataFrame, modes: list[str]) -> DataFrame:
    """Every mode's breaks of every edge, once each: (mode, edge_id, fraction, node)."""
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.lit(0.0).alias("fraction"), F.concat(F.lit("n"), "u").alias("node")), F.struct(F.lit(1.0).alias("fraction"), F.concat(F.lit("n"), "v").alias("node")))).alias("b"))
    ends = ends.select(F.explode(F.array(*map(F.lit, modes))).alias("mode"), "edge_id", "b.fraction", "b.node")
    return ends.unionByName(spliced.select("mode", "edge_id", "fraction", "node")).distinct()


def segments(breaks: DataFrame, edges: DataFrame) -> DataFrame:
    """Consecutive breaks of each edge: (mode, edge_id, lo, hi, a, b, cost_m of the edge)."""
    w = Window.partitionBy("mode", "edge_id").orderBy("fraction", "node")
    rows = breaks.select("mode", "edge_id", F.col("fraction").alias("lo"), F.lead("fraction").over(w).alias("hi"), F.col("node").alias("a"), F.lead("node").over(w).alias("b"))
    return rows.where("b IS NOT NULL").join(edges.select("edge_id", "cost_m"), "edge_id")


def adjacency(segs: DataFrame) -> DataFrame:
    """Undirected neighbours (mode, a, b, w), the cheapest of parallel ones."""
    w = (F.col("hi") - F.col("lo")) * F.col("cost_m")
    one = segs.where("a <> b").select("mode", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w"))
    return one.groupBy("mode", "a", "b").agg(F.min("w").alias("w"))


def dijkstra(edges, entries) -> dict:
    """node -> (distance, node before) from entries (node, cost); the node before an entry is None.

    Of equally near nodes before one the smaller name counts, an entry before all.
    """
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best: dict = {}
    queue = [(c, str(n), "", n) for n, c in entries]
    heapq.heapify(queue)
    while queue:
        d, _, p, n = heapq.heappop(queue)
        if n in best:
            continue
        best[n] = d, p or None
        for m, w in near.get(n, ()):
            if m not in best:
                heapq.heappush(queue, (d + w, str(m), n, m))
    return best


def multi_source_distances(adj: DataFrame, entries: DataFrame, distributed: bool | None = None, delta: float | None = None) -> DataFrame:
    """(mode, node, distance, before) of the nodes that an entry (mode, node, cost) reaches; others are absent.

    A mode is searched by one worker while its network is no larger than WORKER_EDGES; beyond that by
    ``delta_stepping`` over the whole cluster (``distributed`` forces either; distances and paths are the
    same, of equally near nodes before one the smaller name counts). No entry at all raises.
    """
    entries = entries.groupBy("mode", "node").agg(F.min("cost").alias("cost"))
    if not entries.limit(1).count():
        raise ValueError("no source to search from")
    if distributed is None:
        largest = adj.groupBy("mode").count().agg(F.max("count")).first()[0] or 0
        distributed = largest > WORKER_EDGES
    if distributed:
        return delta_stepping(adj, entries, delta)
    rows = adj.select("mode", "a", "b", "w").unionByName(entries.select("mode", F.lit(None).cast("string").alias("a"), F.col("node").alias("b"), F.col("cost").alias("w")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf["a"].isna()
        best = dijkstra(zip(pdf["a"][~e], pdf["b"][~e], pdf["w"][~e], strict=True), list(zip(pdf["b"][e], pdf["w"][e], strict=True)))
        out = pd.DataFrame([(n, d, p) for n, (d, p) in best.items()], columns=["node", "distance", "before"])
        out.insert(0, "mode", pdf["mode"].iloc[0])
        return out

    return rows.groupBy("mode").applyInPandas(search, "mode string, node string, distance double, before string")


def delta_stepping(adj: DataFrame, entries: DataFrame, delta: float | None = None) -> DataFrame:
    """Shortest paths by distance buckets of width ``delta`` (``BUCKET_EDGES`` mean edges unless given), all modes at once.

    Nodes that are reached but not settled are open; they alone are rewritten by a round. Of these the ones in the lowest bucket
    relax their light edges (no longer than delta) until the bucket is stable; they are then settled, into a
    table of their own for each bucket, and relax their heavy edges once. Edges have no direction, so a node that
    is settled already and that a bucket can reach lies no further back than the longest edge: only the tables of these buckets are
    met. Buckets number at most largest distance / delta; empty ones are skipped.

    Edges and nodes are dealt out by node in as many parts, and edges stay where they are: a round shuffles the nodes that it
    reaches, not the edges.
    """
    adj = cut(adj)
    both = adj.select("mode", "a", "b", "w").unionByName(adj.select("mode", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    parts = max(adj.sparkSession.sparkContext.defaultParallelism, -(-2 * adj.count() // TASK_EDGES))
    both = dealt(both, parts, "mode", "a")
    facts = both.agg(F.avg("w").alias("mean"), F.max("w").alias("most")).first()
    delta = delta or BUCKET_EDGES * (facts["mean"] or 1.0) or 1.0
    light, heavy = both.where(F.col("w") <= delta), both.where(F.col("w") > delta)
    any_heavy, back = (facts["most"] or 0.0) > delta, math.ceil((facts["most"] or 0.0) / delta) + 1
    state = F.struct("distance", "before")
    opened = cut(entries.select("mode", "node", F.col("cost").alias("distance"), F.lit(None).cast("string").alias("before"), F.lit(True).alias("fresh")).repartition(parts, "mode", "node"))
    settled: list[tuple[int, DataFrame]] = []

    def relaxed(front: DataFrame, edges: DataFrame, done: list[DataFrame]) -> DataFrame:
        """Open nodes after the edges of ``front`` were relaxed; fresh are those that came nearer."""
        on = (front.mode == edges.mode) & (front.node == edges.a)
        step = front.join(edges, on).select(front.mode, F.col("b").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.col("node").alias("before"))
        if done:
            old = reduce(DataFrame.unionByName, [t.select("mode", "node") for t in done])
            step = step.join(old, ["mode", "node"], "left_anti")
        rows = opened.select("mode", "node", state.alias("s"), F.col("distance").alias("was")).unionByName(step.select("mode", "node", state.alias("s"), F.lit(None).cast("double").alias("was")))
        best = rows.repartition(parts, "mode", "node").groupBy("mode", "node").agg(F.min("s").alias("s"), F.min("was").alias("was"))
        return cut(best.select("mode", "node", "s.distance", "s.before", F.coalesce(F.col("s.distance") < F.col("was"), F.lit(True)).alias("fresh")))

    while True:
        low = opened.agg(F.min("distance")).first()[0]
        if low is None:
            break
        bucket = math.floor(low / delta)
        end = max((bucket + 1) * delta, math.nextafter(low, math.inf))
        recent = [t for b, t in settled if b >= bucket - back]
        front = opened.where(F.col("distance") < end)
        while front.limit(1).count():
            opened = relaxed(front, light, recent)
            front = opened.where(F.col("fresh") & (F.col("distance") < end))
        mine = cut(opened.where(F.col("distance") < end).select("mode", "node", "distance", "before"))
        settled.append((bucket, mine))
        opened = opened.where(F.col("distance") >= end)
        if any_heavy:
            opened = relaxed(mine, heavy, [*recent, mine])
    return reduce(DataFrame.unionByName, [t for _, t in settled])


def cell_distances(cells: DataFrame, segs: DataFrame, reached: DataFrame) -> DataFrame:
    """(mode, point_id, distance): the cell's connector once, plus the way over the nearer of its two breaks; inf where unreached.

    ``cells``: point_id, edge_id, fraction, connector_m. A position on a break belongs to any segment
    that touches it; the smallest result counts, so ties don't matter.
    """
    d = reached.select("mode", "node", "distance")
    s = segs.join(d.toDF("mode", "a", "da"), ["mode", "a"], "left").join(d.toDF("mode", "b", "db"), ["mode", "b"], "left")
    on = (cells.edge_id == s.edge_id) & (cells.fraction >= s.lo) & (cells.fraction <= s.hi)
    inf = F.lit(math.inf)
    way = F.least(F.coalesce("da", inf) + (F.col("fraction") - F.col("lo")) * F.col("cost_m"), F.coalesce("db", inf) + (F.col("hi") - F.col("fraction")) * F.col("cost_m"))
    return cells.join(s, on).groupBy("mode", "point_id").agg(F.min(F.col("connector_m") + way).alias("distance"))


def service_area(segs: DataFrame, reached: DataFrame, budget: float) -> DataFrame:
    """Per mode: segments wholly, partly and not within the budget, and the reachable length in metres."""
    d = reached.select("mode", "node", "distance")
    s = segs.join(d.toDF("mode", "a", "da"), ["mode", "a"], "left").join(d.toDF("mode", "b", "db"), ["mode", "b"], "left")
    length = (F.col("hi") - F.col("lo")) * F.col("cost_m")
    ra, rb = (F.greatest(F.lit(0.0), F.lit(budget) - F.coalesce(c, F.lit(math.inf))) for c in ("da", "db"))
    a, b = F.coalesce(F.col("da") <= budget, F.lit(False)), F.coalesce(F.col("db") <= budget, F.lit(False))
    got = F.when(a & b, length).otherwise(F.least(length, ra + rb))
    return s.groupBy("mode").agg(F.count_if(a & b).alias("whole"), F.count_if(a != b).alias("part"), F.count_if(~a & ~b).alias("none"), F.round(F.sum(got), 3).alias("reachable_m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node reaches. Labels move and jump until none changes."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        low = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("low"))
        step = labels.join(low, labels.node == low.u).select("node", F.least("comp", "low").alias("next"), F.col("comp").alias("was"))
        hop = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        new = cut(step.join(hop, "next").select("node", F.least("next", "beyond").alias("comp"), "was"))
        if not new.where("comp <> was").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def trace(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """(mode, node, path): the nodes from the entry to each target (mode, node); empty where unreached.

    Jumps over 1, 2, 4 ... nodes are made by doubling, then the targets' ways are filled in from the longest jump
    to the shortest: two joins for each doubling of the longest way, not one for each of its nodes.
    """
    jumps = [cut(reached.where("before IS NOT NULL").select("mode", "node", F.col("before").alias("up")))]
    while True:
        last = jumps[-1]
        beyond = last.select("mode", F.col("node").alias("up"), F.col("up").alias("beyond"))
        further = cut(last.join(beyond, ["mode", "up"]).select("mode", "node", F.col("beyond").alias("up")))
        if not further.limit(1).count():
            break
        jumps.append(further)
    known = targets.select("mode", "node").distinct().join(reached.select("mode", "node"), ["mode", "node"])
    steps = cut(known.select("mode", "node", F.col("node").alias("at"), F.lit(0).alias("back")))
    for k, jump in reversed(list(enumerate(jumps))):
        more = steps.join(jump.select("mode", F.col("node").alias("at"), "up"), ["mode", "at"])
        steps = cut(steps.unionByName(more.select("mode", "node", F.col("up").alias("at"), (F.col("back") + 2**k).alias("back"))))
    ways = steps.groupBy("mode", "node").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "at"))).alias("w"))
    out = targets.select("mode", "node").distinct().join(ways, ["mode", "node"], "left")
    return out.select("mode", "node", F.coalesce(F.transform("w", lambda x: x["at"]), F.array().cast("array<string>")).alias("path"))


def path_legs(paths: DataFrame, segs: DataFrame) -> DataFrame:
    """(mode, node, leg, edge_id, lo, hi) of the ways of ``trace``: the stretch of an edge between each two nodes that follow, the cheapest of parallel ones; legs count from 1."""
    steps = paths.select("mode", "node", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).alias("leg")).where(F.col("leg") < F.size("path"))
    a, b = F.get("path", F.col("leg") - 1), F.get("path", F.col("leg"))
    steps = steps.select("mode", "node", "leg", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    ends = segs.where("a <> b").select("mode", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ((F.col("hi") - F.col("lo")) * F.col("cost_m")).alias("w"), "edge_id", "lo", "hi")
    best = ends.groupBy("mode", "a", "b").agg(F.min(F.struct("w", "edge_id", "lo", "hi")).alias("s"))
    return steps.join(best, ["mode", "a", "b"]).select("mode", "node", "leg", "s.edge_id", "s.lo", "s.hi")


def leaving(legs: DataFrame, parts: DataFrame) -> DataFrame:
    """(mode, node, name, legs, crosses, first_leg): whether a way leaves its polygon, and on which leg first.

    ``legs`` as of ``path_legs`` with ``name``, the way's polygon; ``parts`` are the stretches of edges inside polygons (``shapes.inside_parts``). A leg
    stays inside if the polygon's stretches cover it.
    """
    mine = parts.select("edge_id", "name", "f0", "f1")
    held = legs.join(mine, ["edge_id", "name"], "left")
    # least and greatest leave nulls out: a leg without any stretch inside has none
    both = F.when(F.col("f0").isNotNull(), F.greatest(F.lit(0.0), F.least("hi", "f1") - F.greatest("lo", "f0")))
    each = held.groupBy("mode", "node", "name", "leg", "lo", "hi").agg(F.coalesce(F.sum(both), F.lit(0.0)).alias("inside"))
    out = F.col("inside") < F.col("hi") - F.col("lo") - 1e-9
    return each.groupBy("mode", "node", "name").agg(F.count("*").alias("legs"), F.max(out).alias("crosses"), F.min(F.when(out, F.col("leg"))).alias("first_leg"))
