"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams stand in one global order: the uncommon ones first, then the common ones, each by hash. The order is
cut into fragments, what a pair of sets has in common is counted in each fragment by itself, and the counts are
summed per pair.

1. Every text becomes the set of its n-grams (64-bit hashes); equal sets are one class.
2. The head fragment of a set are its first n - ceil(t n) + 1 n-grams. Two sets with similarity t or more have an
   n-gram in both heads, whatever the order. Common n-grams are those that more than ``COMMON`` classes have in their
   windows, the window of a set being somewhat more of it, by hash, than its head. A bitmap of bounded size marks them;
   the order is what the bitmap says, so its false marks are part of the order and lose nothing. A set whose window
   holds too few uncommon n-grams gets its head from its whole text. A second bitmap, of n-grams that occur in two
   windows or in such a head, keeps those that no other set can have out of the shuffle.
3. Classes that share an n-gram of their heads become pairs. Their overlap in the head fragment is counted; what it
   leaves possible (that count and all that lies behind the shorter head) decides which pairs go on.
4. For these, the rest of the order is cut into ``FRAGMENTS`` ranges; whole sets are cut at them, each fragment's
   overlap is counted by itself, and sums per pair are tested exactly.
5. Links make components.

An n-gram of the heads may be shared by very many classes all the same (near copies of one text). Then only a few
leaders are paired with all, and where this leaves its classes in several components, they are dealt into blocks
and every pair of blocks is counted fragment by fragment, as in the near-duplicate operator. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, bounded_batches, chunks
from netaccess.llm.neardup import _digest, _Hashes, forest, merged, prefiltered, shingle_set

#: An n-gram is common if more classes have it. Bits of a bitmap for each n-gram in it, and at most (16 MB go to the
#: tasks): beyond it more false marks are made, which cost time alone.
COMMON, MARK_BITS, MARK_MOST = 16, 16, 2**27
#: N-grams shared by at most SMALL classes' heads make pairs of all; beyond, about LEADERS of them are paired with all.
SMALL, LEADERS = 16, 3
#: Ranges of the order that whole sets are cut into.
FRAGMENTS = 8
#: Classes, and n-grams in their sets, of a block of a large key (one class at least).
BLOCK, BLOCK_HASHES = 512, 500_000
_TOP = np.uint64(1 << 63)


def ordered_set(text: str | None, words: dict, width: int) -> np.ndarray:
    """The distinct n-grams as signed hashes, ascending."""
    return (shingle_set(text, words, width) ^ _TOP).view(np.int64)


def head_length(n: int, threshold: int) -> int:
    """Places of the head fragment of a set of n; 0 for the empty set."""
    return n - -(-threshold * n // 100) + 1 if n else 0


def window_length(n: int, threshold: int) -> int:
    p = head_length(n, threshold)
    return min(n, p + p // 2 + 4) if n else 0


class Marks:
    """A bitmap of hashes: membership, with false marks."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits = bits
        self.map = np.zeros(max(bits, 8) // 8, dtype=np.uint8)
        for part, m in parts.items():
            self.map[part * 4096 : part * 4096 + len(m)] = np.frombuffer(m, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(hashes), dtype=bool)
        p = hashes & np.int64(self.bits - 1)
        return (self.map[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def head(s: np.ndarray, marks: Marks, n: int, threshold: int) -> tuple[np.ndarray, int, int] | None:
    """(head fragment, whether it ends in common n-grams as 0 or 1, its last n-gram) of a set of n.

    ``s`` is the set in ascending order, or the start of it; None where that start doesn't hold the head.
    """
    common = marks.has(s)
    p = head_length(n, threshold)
    first = s[~common][:p]
    if len(first) == p:
        return first, 0, int(first[-1]) if p else 0
    if len(s) < n:
        return None
    first = np.concatenate([first, s[common][: p - len(first)]])
    return first, 1, int(first[-1])


def _profiles(width: int, threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Hashes()
        for pdf in batches:
            for part in chunks(pdf, "t", rows=1000):
                sets = [ordered_set(t, words, width) for t in part["t"]]
                digests = [_digest(s) for s in sets]
                windows = [s[: window_length(len(s), threshold)] for s in sets]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], "a": [d[0] for d in digests], "b": [d[1] for d in digests], "win": windows})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Hashes()
        for pdf in batches:
            for part in chunks(pdf, "t", rows=500):
                sets = [ordered_set(t, words, width) for t in part["t"]]
                yield pd.DataFrame({"a": [_digest(s)[0] for s in sets], "s": sets})

    return run


def _short(marks: Marks, threshold: int):
    """Classes whose window doesn't hold their head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["a", "rep"]][[head(np.asarray(w), marks, n, threshold) is None for w, n in zip(pdf["win"], pdf["n"], strict=True)]]

    return run


def _heads(marks: Marks, shared: Marks | None, threshold: int):
    """Heads of sets or windows ``s``; with ``shared`` without the n-grams that no other head has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, s, n in zip(pdf["a"], pdf["s"], pdf["n"], strict=True):
                found = head(np.asarray(s), marks, n, threshold)
                if found is not None:
                    rows.append((a, found[0] if shared is None else found[0][shared.has(found[0])], *found[1:]))
            yield pd.DataFrame(rows, columns=["a", "head", "lv", "last"]).astype({"a": "int64", "lv": "int32", "last": "int64"})

    return run


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets cut at the borders of the fragments; fragments without n-grams give no row."""
    cuts = (np.arange(1, FRAGMENTS, dtype=np.float64) / FRAGMENTS * 2.0**64 - 2.0**63).astype(np.int64)
    for pdf in batches:
        node, f, seg = [], [], []
        for a, s in zip(pdf["a"], pdf["s"], strict=True):
            for i, part in enumerate(np.split(np.asarray(s), np.searchsorted(s, cuts))):
                if len(part):
                    node.append(a)
                    f.append(i)
                    seg.append(part)
        yield pd.DataFrame({"node": node, "f": f, "s": seg}).astype({"node": "int64", "f": "int32"})


def _block_links(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comp, found = pdf["node"].tolist(), pdf["comp"].tolist(), []
        if len(set(comp)) > 1:
            found = forest([np.asarray(s) for s in pdf["s"]], comp, [int(b) for b in pdf["i"] != pdf["bi"]], threshold)
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["u", "v"]).astype("int64")

    return run


def _marks(keys: DataFrame) -> Marks:
    """The bitmap over the column ``key`` (distinct n-grams)."""
    n = keys.count()
    if not n:
        return Marks({}, 0)
    bits = 2**15
    while bits < min(MARK_BITS * n, MARK_MOST):
        bits *= 2
    parts = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("p")).groupBy(F.floor(F.col("p") / 2**15).cast("int").alias("part"))
    return Marks({r["part"]: bytes(r["m"]) for r in parts.agg(F.bitmap_construct_agg(F.col("p") % 2**15).alias("m")).collect()}, bits)


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of distinct ``ids``: a bitmap lets few others through to the shuffle, a merge join decides."""
    return prefiltered(rows, ids, ids.count()).join(ids.hint("merge"), "id").select("id", "t")


def similar_components(docs: DataFrame, threshold: int = 85, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents are linked where 100 * intersection >= threshold * union of their sets of ``width``-word n-grams
    (A-Z lower-cased; with fewer words the whole sequence is one). component_id is the smallest doc_id reachable by
    links, itself included. A null text or one without words has an empty set and no links. Rows that repeat a doc_id
    are judged by their own texts; a row without a doc_id is linked with nothing and has a null component. doc_id
    is a long; other columns are not read. An empty table gives an empty result. Texts of any length are read whole.
    """
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    base = scratch.keep(rows.mapInPandas(_profiles(width, threshold), "id long, n long, a long, b long, win array<long>"))
    full = base.where("n > 0 AND id IS NOT NULL")
    # a class is named by its digest's first half: ids may repeat in several texts
    names = scratch.keep(full.groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("win").alias("win")))
    seen = scratch.keep(names.select(F.explode("win").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    marks = _marks(seen.where(F.col("m") > COMMON).select("key"))
    short = scratch.keep(names.mapInPandas(_short(marks, threshold), "a long, rep long"))
    whole = _texts(rows, short.select(F.col("rep").alias("id")).distinct()).mapInPandas(_sets(width), "a long, s array<long>")
    whole = whole.join(short.select("a").hint("merge"), "a", "left_semi").groupBy("a").agg(F.first("s").alias("s")).select("a", "s", F.size("s").cast("long").alias("n"))
    schema = "a long, head array<long>, lv int, last long"
    late = scratch.keep(whole.mapInPandas(_heads(marks, None, threshold), schema))
    twice = _marks(seen.select("key").union(late.select(F.explode("head"))).distinct())
    early = names.select("a", F.col("win").alias("s"), "n").mapInPandas(_heads(marks, twice, threshold), schema)
    heads = scratch.keep(early.unionByName(late))
    classes = names.select("a", "rep", "n").join(heads.hint("merge"), "a")
    keyed = heads.select("a", F.explode("head").alias("key"))
    # merge joins on keys: a key of very many classes is a skewed partition, which adaptive execution splits
    counts = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    place = F.pmod(F.xxhash64(F.lit(5), F.col("a")), F.lit(2**40)).cast("double") / float(2**40)
    shared = scratch.keep(keyed.join(counts.hint("merge"), "key").select("key", "m", F.col("a").alias("node"), place.alias("h")))
    nodes = shared.select("node").distinct()
    size = classes.select("a", "rep", "n", "lv", "last")
    candidates = scratch.keep(size.join(nodes.hint("merge"), size.a == nodes.node, "left_semi"))
    # pairs with their overlap in the head fragment
    leads = (F.col("m") <= SMALL) | (F.col("h") * F.col("m") < LEADERS)
    lead = shared.where(leads).select("key", F.col("node").alias("u"), F.col("h").alias("hu"))
    pairs = shared.select("key", "m", F.col("node").alias("v"), F.col("h").alias("hv")).join(lead.hint("merge"), "key")
    pairs = pairs.where((F.col("hv") > F.col("hu")) | ((F.col("hv") == F.col("hu")) & (F.col("v") > F.col("u"))))
    pairs = pairs.groupBy("u", "v").agg(F.count("*").alias("c"), (F.max("m") > SMALL).alias("large"))
    facts = candidates.select("a", "n", "lv", "last")
    near = pairs.join(facts.toDF("u", "nu", "lu", "eu"), "u").join(facts.toDF("v", "nv", "lv", "ev"), "v")
    need = F.col("nu") + F.col("nv")
    behind = lambda n: F.col(n) - (F.col(n) - F.ceil(F.col(n) * threshold / 100) + 1)
    # all n-grams up to where the earlier head ends are in both heads: only what lies behind it is not counted yet
    u_first = F.struct("lu", "eu") <= F.struct("lv", "ev")
    most = F.col("c") + F.when(u_first, behind("nu")).otherwise(behind("nv"))
    fits = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * threshold
    # pairs of leaders were not made for every n-gram they share, so their count bounds nothing
    near = scratch.keep(near.where(fits & (F.col("large") | (most * (100 + threshold) >= need * threshold))).select("u", "v", "nu", "nv"))
    # whole sets of the classes that pairs or large keys still need, from the text of their smallest document
    large_nodes = shared.where(F.col("m") > SMALL).select("node")
    wanted = near.select(F.col("u").alias("node")).union(near.select("v")).union(large_nodes).distinct()
    wanted = scratch.keep(candidates.join(wanted.hint("merge"), candidates.a == F.col("node")).select("a", "rep"))
    sets = _texts(rows, wanted.select(F.col("rep").alias("id")).distinct()).mapInPandas(_sets(width), "a long, s array<long>")
    sets = sets.join(wanted.select("a").hint("merge"), "a", "left_semi").groupBy("a").agg(F.first("s").alias("s"))
    cut = scratch.keep(sets.mapInPandas(_segments, "node long, f int, s array<long>"))
    # every fragment counts its own part of the overlap; the parts are summed per pair
    parts = near.join(cut.toDF("u", "f", "xu").hint("merge"), "u").join(cut.toDF("v", "f", "xv").hint("merge"), ["v", "f"])
    parts = parts.select("u", "v", "nu", "nv", F.size(F.array_intersect("xu", "xv")).alias("both"))
    both = parts.groupBy("u", "v").agg(F.first("nu").alias("nu"), F.first("nv").alias("nv"), F.sum("both").alias("both"))
    links = both.where(F.col("both") * 100 >= (F.col("nu") + F.col("nv") - F.col("both")) * threshold)
    labels = scratch.keep(candidates.select(F.col("a").alias("node"), F.col("a").alias("comp")))
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
        joined = cut.groupBy("node").agg(F.flatten(F.collect_list("s")).alias("s"))
        dealt = dealt.select("first", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), "i", "node", "comp").join(joined, "node")
        links = dealt.groupBy("first", "bi", "bj").applyInPandas(_block_links(threshold), "u long, v long")
        labels = merged(labels, scratch.keep(links.distinct()), scratch)
    scratch.drop(cut, shared, members, near, wanted, heads, late, short, seen)
    # from digests to smallest doc_ids
    reps = candidates.join(labels, candidates.a == labels.node).select("a", "rep", "comp")
    smallest = reps.groupBy("comp").agg(F.min("rep").alias("component"))
    # classes without a component meet nothing on it: their nulls would all go to one task
    named = names.select("a", "b", "rep").join(reps.select("a", "comp").join(smallest, "comp").select("a", "component"), "a", "left")
    named = named.select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("a")).alias("a"), "b")
    out = out.join(named.hint("merge"), ["a", "b"], "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
