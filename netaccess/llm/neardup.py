"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join, links confirmed exactly.

1. Every document gets its set of word shingles (hashed to 64 bits), a 128-bit digest of the set and a
   signature of 32 MinHash values of 16 bits, held as 8 chunks of 4. Equal sets become one class.
2. Signatures that differ in at most 15 of the 32 places must, by the pigeonhole principle, have a chunk
   with at most one wrong place (8 chunks with 2 wrong places each would be 16). So each chunk gives 4 keys, each
   leaving one place out, and all pairs within distance 15 share a key. At similarity 0.85 a pair is
   beyond that distance with probability 3.5e-6 (it is then missed; above 0.85 far more seldom).
3. Classes that share a key are compared: first signatures (at most 15 places), then full sets.
4. Links make components.

A key can be shared by very many classes, so its classes aren't paired off as rows. Keys with few classes
are compared pair by pair; of larger ones only a few leaders (chosen by hash) are compared with all, and
the links merged into components. Larger keys whose classes are then not all in one component are
finished exactly: their classes gather under the key's first leader, are dealt into blocks of bounded
size, and each pair of blocks counts common shingles of all its classes by matrix products and returns no
more links than it has classes (a spanning forest). Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, bounded_batches, byte_words

#: Chunks of the signature, places of a chunk (16 bits each, so a chunk is a long), largest distance.
CHUNKS, PLACES, DISTANCE = 8, 4, 15
#: Keys of at most SMALL classes are compared pair by pair; larger ones with about LEADERS of their classes.
SMALL, LEADERS = 8, 3
#: Classes, and hashes in their sets, of a block of a large key (one class at least).
BLOCK, BLOCK_HASHES = 512, 500_000
#: Nodes whose links a task joins at a time, before any are shuffled.
JOINED = 200_000
#: Bits of the filter of ids for each id in it, and at most (32 MB are broadcast): beyond it the filter lets more
#: rows through, and the join after it, which decides, reads more.
FILTER_BITS, FILTER_MOST = 16, 2**28
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, CHUNKS * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, CHUNKS * PLACES, dtype=np.uint64)
_P = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: dict, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words the sequence is one; none without words."""
    found = byte_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n, w = len(h), min(width, len(h))
    total = np.full(n - w + 1, w, dtype=np.uint64)
    for i in range(w):
        total = _mix(total + h[i : n - w + 1 + i] * _P[i])
    total = np.sort(total)
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 8 chunks, as signed longs."""
    low = np.empty(CHUNKS * PLACES, dtype=np.uint64)
    step = max(1, 200_000 // (CHUNKS * PLACES))
    for s in range(0, len(hashes), step):
        part = (hashes[s : s + step, None] * _A + _B).min(0)
        low = part if s == 0 else np.minimum(low, part)
    b = _mix(low).reshape(CHUNKS, PLACES) & np.uint64(0xFFFF)
    return (b[:, 0] | b[:, 1] << np.uint64(16) | b[:, 2] << np.uint64(32) | b[:, 3] << np.uint64(48)).view(np.int64)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(hashes.tobytes())
    return (d >> 64) - 2**63, (d & 2**64 - 1) - 2**63


def _profiles(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Hashes()
        for pdf in batches:
            n, a, b, sig = [], [], [], []
            for text in pdf["t"]:
                s = shingle_set(text, words, width)
                n.append(len(s))
                for half, value in zip((a, b), _digest(s), strict=True):
                    half.append(value)
                sig.append(signature(s) if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "a": a, "b": b, "sig": sig})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Hashes()
        for pdf in batches:
            for s in range(0, len(pdf), 500):
                part = pdf.iloc[s : s + 500]
                sets = [shingle_set(t, words, width) for t in part["t"]]
                yield pd.DataFrame({"a": [_digest(s)[0] for s in sets], "s": [s.view(np.int64) for s in sets]})

    return run


def prefiltered(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose id may be among ``ids`` (n of them), by a bitmap of bounded size, before anything is shuffled."""
    bits = 2**15
    while bits < min(FILTER_BITS * n, FILTER_MOST):
        bits *= 2
    at = lambda c: F.pmod(F.xxhash64(F.lit(21), F.col(c)), F.lit(bits))
    maps = ids.select(at("id").alias("p")).groupBy(F.floor(F.col("p") / 2**15).cast("long").alias("part"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("p") % 2**15).alias("m"))
    rows = rows.withColumn("p", at("id"))
    byte = F.conv(F.hex(F.substring(F.col("m"), (F.floor((F.col("p") % 2**15) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.floor(rows.p / 2**15).cast("long") == F.col("part")
    return rows.join(F.broadcast(maps), on).where(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1).drop("p", "part", "m")


def _distance(a: str, b: str):
    """Places in which two signatures differ."""
    lane = [0xFFFF << 16 * p for p in range(PLACES)]
    signed = [x - 2**64 if x >= 2**63 else x for x in lane]
    terms = [
        F.when(F.col(a)[c].bitwiseXOR(F.col(b)[c]).bitwiseAND(F.lit(m)) != 0, 1).otherwise(0) for c in range(CHUNKS) for m in signed
    ]
    return reduce(lambda x, y: x + y, terms)


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) that join the same nodes as those of the batches: each node with the smallest one that it is joined to there.

    Long ways within a task become one step, so components are found in fewer rounds. A task holds about JOINED nodes at a time.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def found() -> pd.DataFrame:
        ends = [(x, find(x)) for x in list(root)]
        led = {r for x, r in ends if x != r}
        return pd.DataFrame([(x, r) for x, r in ends if x != r or x not in led], columns=["u", "v"]).astype("int64")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        if len(root) > JOINED:
            yield found()
            root.clear()
    yield found()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the edges (u, v): comp is the smallest node reachable.

    Labels move along edges and then jump along themselves until none changes. Sums are made before the
    shuffle, so a node with very many edges costs one row for each task; nothing comes to the driver
    but the number of changes.
    """
    both = scratch.keep(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("low"))
        step = labels.join(near, labels.node == near.u).select("node", F.least("comp", "low").alias("next"), F.col("comp").alias("was"))
        hop = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        step = step.join(hop, "next", "left").select("node", F.least(F.coalesce("beyond", "next"), F.col("next")).alias("comp"), "was")
        kept = scratch.keep(step)
        changed = kept.where("comp <> was").limit(1).count()
        scratch.drop(labels)
        labels = kept.select("node", "comp")
        scratch.paths[id(labels)] = scratch.paths.pop(id(kept))
        if not changed:
            scratch.drop(both)
            return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, comp) after the links (u, v) between nodes, a written table; no plan is run where there are none."""
    if not links.limit(1).count():
        scratch.drop(links)
        return labels
    name = labels.toDF("x", "c")
    edges = links.mapInPandas(stars, "u long, v long").join(name.toDF("u", "cu"), "u").join(name.toDF("v", "cv"), "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    found = components(edges, scratch)
    out = scratch.keep(labels.join(found.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
    scratch.drop(labels, found, links)
    return out


def forest(sets: list[np.ndarray], comp: list[int], block: list[int], threshold: int) -> list[tuple[int, int]]:
    """Links (positions) that join what the sets' links join, given components that are joined already.

    ``block`` is 0 or 1 for each set; with both present only links between the two are looked for.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    left = [i for i, b in enumerate(block) if b == 0] or list(range(len(sets)))
    right = [i for i, b in enumerate(block) if b == 1] or left
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what only one set has is in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner, width = column[at[keep]], owner[keep], int(shared.sum())
    place = np.full(len(sets), -1)
    common = np.zeros((len(left), len(right)), dtype=np.float32)

    def dense(chosen: list[int], lo: int, hi: int) -> np.ndarray:
        place[:] = -1
        place[chosen] = np.arange(len(chosen))
        m = np.zeros((len(chosen), hi - lo), dtype=np.float32)
        use = (at >= lo) & (at < hi) & (place[owner] >= 0)
        m[place[owner[use]], at[use] - lo] = 1
        return m

    for lo in range(0, width, 4096):
        hi = min(width, lo + 4096)
        common += dense(left, lo, hi) @ dense(right, lo, hi).T
    linked = common * 100.0 >= (sizes[left][:, None] + sizes[right][None, :] - common) * threshold
    out = []
    for x, y in zip(*np.nonzero(linked), strict=True):
        i, j = left[x], right[y]
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _block_links(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comp = pdf["node"].tolist(), pdf["comp"].tolist()
        found = []
        if len(set(comp)) > 1:
            found = forest([np.asarray(s) for s in pdf["s"]], comp, [int(b) for b in pdf["i"] != pdf["bi"]], threshold)
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["u", "v"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, threshold: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * intersection >= threshold * union of their shingle sets (the
    distance bound above suits 85 and more; at similarity 0.8 itself it misses 1 pair in 7000).
    component_id is the smallest doc_id reachable by links, kept is doc_id = component_id. Documents with
    a null text or no words have an empty set and no links. Rows that repeat a doc_id are judged by
    their own texts. A row without a doc_id is linked with nothing, has a null component and is kept.
    """
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    base = scratch.keep(rows.mapInPandas(_profiles(width), "id long, n long, a long, b long, sig array<long>"))
    full = base.where("n > 0 AND id IS NOT NULL")
    classes = scratch.keep(full.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    mask = [-1 - ((0xFFFF << 16 * p) if p < 3 else (0xFFFF << 48) - 2**64) for p in range(PLACES)]
    # a class is named by its digest's first half: ids may repeat in several texts
    keyed = classes.select(
        "rep", "a", F.explode(F.array(*[F.xxhash64(F.lit(c * PLACES + p), F.col("sig")[c].bitwiseAND(F.lit(mask[p]))) for c in range(CHUNKS) for p in range(PLACES)])).alias("key")
    )
    # merge joins on keys: a key of very many classes is a skewed partition, which adaptive execution splits
    counts = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    place = F.pmod(F.xxhash64(F.lit(5), F.col("a")), F.lit(2**40)).cast("double") / float(2**40)
    shared = scratch.keep(keyed.join(counts.hint("merge"), "key").select("key", "m", F.col("a").alias("node"), place.alias("h")))
    nodes = shared.select("node").distinct()
    candidates = scratch.keep(classes.join(nodes, classes.a == nodes.node, "left_semi").select("a", "rep", "n", "sig"))
    # the full sets of those classes alone, from the text of their smallest document; other texts are not shuffled
    ids = candidates.select(F.col("rep").alias("id")).distinct()
    likely = prefiltered(rows, ids, candidates.count())
    # a merge join at every size: the ids grow with the documents, so they are never broadcast; an inner one of distinct
    # ids, as the optimizer would move a semi join before the filter
    sets = likely.join(ids.hint("merge"), "id").select("id", "t").mapInPandas(_sets(width), "a long, s array<long>")
    sets = scratch.keep(sets.join(candidates, "a", "left_semi").groupBy("a").agg(F.first("s").alias("s")))
    labels = scratch.keep(candidates.select(F.col("a").alias("node"), F.col("a").alias("comp")))
    sig = candidates.select("a", "n", "sig")
    leads = (F.col("m") <= SMALL) | (F.col("h") * F.col("m") < LEADERS)
    lead = shared.where(leads).select("key", F.col("node").alias("u"), F.col("h").alias("hu"))
    pairs = shared.select("key", F.col("node").alias("v"), F.col("h").alias("hv")).join(lead.hint("merge"), "key")
    pairs = pairs.where((F.col("hv") > F.col("hu")) | ((F.col("hv") == F.col("hu")) & (F.col("v") > F.col("u")))).select("u", "v").distinct()
    near = pairs.join(sig.toDF("u", "nu", "su"), "u").join(sig.toDF("v", "nv", "sv"), "v")
    # a link needs sizes within the threshold of each other
    fits = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * threshold
    near = near.where(fits & (_distance("su", "sv") <= DISTANCE)).select("u", "v", "nu", "nv")
    near = near.join(sets.toDF("u", "xu"), "u").join(sets.toDF("v", "xv"), "v")
    both = F.size(F.array_intersect("xu", "xv"))
    links = near.withColumn("both", both).where(F.col("both") * 100 >= (F.col("nu") + F.col("nv") - F.col("both")) * threshold)
    labels = merged(labels, scratch.keep(links.select("u", "v")), scratch)
    # large keys whose classes aren't all in one component yet
    large = shared.where(F.col("m") > SMALL).join(labels, "node")
    first = large.groupBy("key").agg(F.min_by("node", "h").alias("first"), (F.min("comp") != F.max("comp")).alias("open")).where("open")
    members = scratch.keep(large.join(first.select("key", "first").hint("merge"), "key").select("first", "node", "comp").distinct())
    if members.limit(1).count():
        sized = members.join(candidates.select(F.col("a").alias("node"), "n"), "node").groupBy("first").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        sized = sized.select("first", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_HASHES)).cast("int").alias("blocks"))
        dealt = members.join(sized, "first").withColumn("i", F.pmod(F.xxhash64(F.lit(9), F.col("node")), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("first", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), "i", "node", "comp").join(sets.withColumnRenamed("a", "node"), "node")
        links = dealt.groupBy("first", "bi", "bj").applyInPandas(_block_links(threshold), "u long, v long")
        labels = merged(labels, scratch.keep(links.distinct()), scratch)
    scratch.drop(sets, shared, members)
    # from digests to smallest doc_ids
    reps = candidates.join(labels, candidates.a == labels.node).select("a", "rep", "comp")
    smallest = reps.groupBy("comp").agg(F.min("rep").alias("component"))
    named = classes.select("a", "b", "rep").join(reps.select("a", "comp"), "a", "left").join(smallest, "comp", "left")
    named = named.select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("a")).alias("a"), "b")
    out = out.join(named, ["a", "b"], "left")
    component = F.coalesce("component_id", "id")
    out = scratch.keep(out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
    scratch.drop(base, classes, candidates, labels)
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component of linked texts, with all columns.

    Rows are told apart by a key of their own, so ids may be missing or repeated: copies of a text leave one
    row, and the several texts of one id are judged each for itself. Of a component the row with the
    smallest id stays, rows without one last; then the text's digest and the row's number decide. Rows with
    a null text or no words are linked with nothing and stay.
    """
    scratch = Scratch(docs.sparkSession)
    # written once: the numbers must not change between the plans that read them; the row is apart from what is added
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = scratch.keep(docs.select(F.monotonically_increasing_id().alias("r"), F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), row.alias("row")))
    found = near_duplicates(keyed, doc_id="r", text="t", **options).select(F.col("doc_id").alias("r"), "component_id")
    linked = found.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id")
    names = keyed.select("r", F.struct(F.col("i").isNull().alias("none"), F.col("i").alias("id"), F.xxhash64("t").alias("h"), "r").alias("o"))
    grouped = scratch.keep(found.join(linked, "component_id").join(names, "r").select("component_id", "r", "o"))
    stays = grouped.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.r").alias("r"))
    gone = scratch.keep(grouped.join(stays, "r", "left_anti").select("r"))
    kept = keyed.join(gone, "r", "left_anti")
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
