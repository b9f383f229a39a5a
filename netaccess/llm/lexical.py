"""Ranked lexical search by inverted treaps.

Documents become rows of the terms that some query has, with their frequencies; a written table of these is the index.
Global counts (documents N, terms L, documents df of each term) come from it in one aggregation. Each task then takes
its documents in blocks and builds one treap per term: a binary tree in search order of the documents and in heap order of the
term's impact, so that a subtree's root is its maximum. A query goes down the treaps of its terms at the same time. An interval of documents
has, for each term, the highest node inside it; the sum of these impacts bounds the score of every document of the
interval. The interval with the largest bound is split at its heaviest node, whose document is scored exactly; one
whose bound cannot enter the k best so far is left out, with all its subtrees. The k best go from block to block
within a task, and the tasks' results meet in one ranking of at most k rows for each task and query.

Documents are never shuffled; only postings of query terms are written. Queries go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, bounded_batches, chunks

#: A term is a run of characters that are none of these; only A-Z are lower-cased. In UTF-8 all other bytes are term bytes.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: Documents, and postings, of a block that treaps are built over (one document at least).
BLOCK, POSTINGS = 16_384, 2_000_000
#: Characters of queries that go to the tasks at a time (one query at least).
QUERY_CHARS = 4_000_000
#: Intervals that are split at once: at first, and at most.
FIRST, MOST = 16, 512


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    """floor(1000 * ln((2n + 2) / (2df + 1)))."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Treaps:
    """One treap for each term over a block of documents; nodes are postings in order of (term, document)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, count: int):
        """``term`` ascending, ``doc`` ascending within a term; ``count`` is the number of terms."""
        n = len(term)
        self.doc, self.impact = doc, impact
        self.left, self.right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        self.root = np.full(count, -1, dtype=np.int64)
        # equal impacts go by a scrambled position: chains of equals would make the trees as deep as long
        scrambled = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((scrambled ^ (scrambled >> np.uint64(29)), impact))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if n else np.zeros(0, dtype=np.int64)
        lo, hi = start, np.concatenate([start[1:], [n]]) if n else start
        parent, side = term[start], np.zeros(len(start), dtype=np.int8)  # side 0: the parent is a term
        padded = np.append(rank, -1)
        # all trees grow by a level at a time: the maximum of each range is the root of its subtree
        while len(lo):
            top = np.maximum.reduceat(padded, np.stack([lo, hi], axis=1).ravel())[::2]
            node = order[top]
            for s, links in ((0, self.root), (1, self.left), (2, self.right)):
                links[parent[side == s]] = node[side == s]
            lo, hi = np.concatenate([lo, node + 1]), np.concatenate([node, hi])
            parent, side = np.concatenate([node, node]), np.repeat(np.array([1, 2], dtype=np.int8), len(node))
            some = hi > lo
            by = np.argsort(lo[some], kind="stable")
            lo, hi, parent, side = lo[some][by], hi[some][by], parent[some][by], side[some][by]

    def _clipped(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The highest nodes of subtrees whose document lies between lo and hi, both exclusive; -1 where there is none."""
        node = node.copy()
        at = np.flatnonzero(node >= 0)
        while len(at):
            d = self.doc[node[at]]
            low, high = d <= lo[at], d >= hi[at]
            node[at[low]], node[at[high]] = self.right[node[at[low]]], self.left[node[at[high]]]
            at = at[(low | high) & (node[at] >= 0)]
        return node

    def search(self, chosen: np.ndarray, size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored): the k best of documents 0 .. size - 1 over the terms ``chosen``.

        Scores of 0, and below ``floor``, are left out. Ties go to the smaller document.
        """
        roots = self.root[chosen]
        nodes = roots[roots >= 0][None, :]
        best, scores, scored = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        if not nodes.size:
            return best, scores, scored
        lo, hi, bound = np.array([-1]), np.array([size]), self.impact[nodes].sum(1)
        floor, step = max(1, floor), FIRST
        while len(lo):
            if len(best) == k:
                floor = max(floor, int(scores[-1]))
                # what can only tie must hold a smaller document
                open_ = (bound > scores[-1]) | (bound >= floor) & (lo + 1 < best[-1])
            else:
                open_ = bound >= floor
            lo, hi, bound, nodes = lo[open_], hi[open_], bound[open_], nodes[open_]
            if not len(lo):
                break
            take = np.argpartition(-bound, step)[:step] if len(lo) > step else np.arange(len(lo))
            rest = np.ones(len(lo), dtype=bool)
            rest[take] = False
            step = min(MOST, step * 2)
            l, h, mine = lo[take], hi[take], nodes[take]
            heavy = np.where(mine >= 0, self.impact[mine], -1).argmax(1)
            d = self.doc[mine[np.arange(len(mine)), heavy]]
            # one way down each treap towards d: what is met before it on either side, and d itself
            q, t = mine.shape
            flat, fl, fd, fh = mine.ravel(), np.repeat(l, t), np.repeat(d, t), np.repeat(h, t)
            below, above, found = np.full(q * t, -1), np.full(q * t, -1), np.full(q * t, -1)
            at, node = np.flatnonzero(flat >= 0), flat[flat >= 0]
            while len(at):
                x, goal = self.doc[node], fd[at]
                sel = (below[at] < 0) & (x < goal) & (x > fl[at])
                below[at[sel]] = node[sel]
                sel = (above[at] < 0) & (x > goal) & (x < fh[at])
                above[at[sel]] = node[sel]
                hit = x == goal
                found[at[hit]] = node[hit]
                node = np.where(goal < x, self.left[node], self.right[node])
                go = ~hit & (node >= 0)
                at, node = at[go], node[go]
            hit = np.flatnonzero(found >= 0)
            for part, links, a, b in ((below, self.left, fl, fd), (above, self.right, fd, fh)):
                open_ = hit[part[hit] < 0]
                part[open_] = self._clipped(links[found[open_]], a[open_], b[open_])
            score = np.where(found >= 0, self.impact[found], 0).reshape(q, t).sum(1)
            scored += q
            good = score >= floor
            best, scores = np.concatenate([best, d[good]]), np.concatenate([scores, score[good]])
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            nodes = np.concatenate([nodes[rest], below.reshape(q, t), above.reshape(q, t)])
            lo, hi = np.concatenate([lo[rest], l, d]), np.concatenate([hi[rest], d, h])
            fresh = nodes[int(rest.sum()) :]
            bound = np.concatenate([bound[rest], np.where(fresh >= 0, self.impact[fresh], 0).sum(1)])
        return best, scores, scored


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf, "t", chars=4_000_000, rows=2000):
                n, at, tf = [], [], []
                for text in part["t"]:
                    found = terms(text)
                    counts = Counter(found)
                    mine = vocabulary.keys() & counts.keys()
                    n.append(len(found))
                    at.append([vocabulary[w] for w in mine])
                    tf.append([counts[w] for w in mine])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": n, "at": at, "tf": tf})

    return run


def _impacts(weights: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 10 + 90 * n * docs // max(1, total)
    return weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _searched(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int, block: int, postings: int):
    """Batches of index rows to each query's k best of the task; queries are (position, terms)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, best = [], 0, {}

        def search(rows: pd.DataFrame) -> None:
            rows = rows.sort_values("id", kind="stable")
            ids, length = rows["id"].to_numpy(), rows["at"].str.len().to_numpy()
            doc = np.repeat(np.arange(len(rows)), length)
            term, tf = (np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[c]]) for c in ("at", "tf"))
            order = np.lexsort((doc, term))
            term, doc, tf = term[order], doc[order], tf[order]
            treaps = Treaps(term, doc, _impacts(weights, term, tf, rows["n"].to_numpy()[doc], docs, total), len(weights))
            for q, chosen in queries:
                old = best.get(q)
                floor = int(old[1][-1]) if old is not None and len(old[1]) == k else 1
                found, scores, scored = treaps.search(chosen, len(rows), k, floor)
                if old is not None:
                    found, scores = np.concatenate([old[0], ids[found]]), np.concatenate([old[1], scores])
                    keep = np.lexsort((found, -scores))[:k]
                    best[q] = found[keep], scores[keep], old[2] + scored
                else:
                    best[q] = ids[found], scores, scored

        for pdf in batches:
            pdf = pdf[pdf["at"].str.len() > 0]
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                held.append(part)
                size += int(part["at"].str.len().sum())
                if size > postings or sum(map(len, held)) >= block:
                    search(pd.concat(held))
                    held, size = [], 0
        if held:
            search(pd.concat(held))
        rows = [(q, int(i), int(s), scored) for q, (ids, scores, scored) in best.items() for i, s in zip(ids, scores, strict=True)]
        yield pd.DataFrame(rows, columns=["q", "doc_id", "score", "scored"]).astype("int64")

    return run


def _query_blocks(queries: DataFrame, item_id: str, text: str, scratch: Scratch) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (item, distinct terms) of about ``QUERY_CHARS`` characters; all rows of an item together."""
    rows = queries.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL AND item IS NOT NULL")
    chars = rows.agg(F.sum(F.length("t").cast("long") + 16).alias("s")).first()["s"] or 0
    blocks = max(1, -(-chars // QUERY_CHARS))
    rows = scratch.keep(rows.withColumn("b", F.pmod(F.xxhash64("item"), F.lit(blocks)))) if blocks > 1 else rows
    for b in range(blocks):
        found: dict = {}
        for r in (rows.where(F.col("b") == b) if blocks > 1 else rows).toLocalIterator():
            found.setdefault(r["item"], set()).update(terms(r["t"]))
        yield sorted(((i, sorted(ts)) for i, ts in found.items() if ts), key=lambda x: x[0])


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """The k documents with the highest score above 0 for each item: item_id, rank (from 1), doc_id, score, scored.

    Terms are the maximal runs of ASCII letters, ASCII digits and non-ASCII characters of the whole text, only A-Z
    lower-cased. N documents have a term, L is the sum of their n terms with repeats, df the documents that hold a term, tf
    its occurrences in one: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + (90 n N) div L, and an item's terms, once
    each, give w * ((1000000000 tf) div (1000 tf + 8 m)). Ties go to the smaller doc_id. Rows of documents that repeat a
    doc_id are documents of their own; rows without a doc_id count in N, L and df and are never answers. Rows that repeat an
    item_id are one item with all their terms; an item without an id or without terms has no rows. Null texts have no
    terms; empty tables give an empty result. doc_id is a long. scored counts the documents that the tasks that gave an
    item's answers scored for it; the others were pruned.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    scratch, found = Scratch(spark), None
    kind = queries.schema[item_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    for items in _query_blocks(queries, item_id, text, scratch):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ts in items for w in ts}))}
        index = scratch.keep(rows.mapInPandas(_postings(vocabulary), "id long, n long, at array<int>, tf array<long>"))
        sizes = index.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
        df = dict(index.select(F.explode("at").alias("at")).groupBy("at").count().collect())  # one row for each term of the block's queries
        weights = np.array([weight(sizes["docs"], df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
        asked = [(q, np.array([vocabulary[w] for w in ts], dtype=np.int64)) for q, (_, ts) in enumerate(items)]
        search = _searched(asked, weights, sizes["docs"], sizes["total"] or 0, k, block, postings)
        best = index.where("id IS NOT NULL").mapInPandas(search, "q long, doc_id long, score long, scored long")
        named = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q long, item {kind.simpleString()}")
        by = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        top = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        top = top.withColumn("scored", F.sum("scored").over(Window.partitionBy("q"))).join(F.broadcast(named), "q")
        top = top.select(F.col("item").alias(item_id), "rank", "doc_id", "score", "scored")
        found = top if found is None else found.unionByName(top)
    return found
