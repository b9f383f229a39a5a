"""N-gram Jaccard join, Lloyd clustering, ranked lexical search: against brute force, and on odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from netaccess.llm import clustering, lexical, ngramjoin
from tests.llm.test_llm import ODD, docs_of, near_copies, prose

# --- n-gram join


def grams(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - min(width, len(words)) + 1)} if words else set()


def brute_join(rows, threshold, width=4):
    """(id, size, smallest id reachable) for rows of distinct ids."""
    sets = {i: grams(t, width) for i, t in rows}
    low = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[b]]
    for _ in sets:
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return sorted((i, len(s), low[i]) for i, s in sets.items())


def joined(spark, rows, **options):
    got = ngramjoin.similar_components(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), **options)
    return sorted(map(tuple, got.collect()))


def test_heads_meet_under_any_order():
    rng = np.random.default_rng(1)
    marks = ngramjoin.Marks({0: rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()}, 2**15)
    for _ in range(300):
        x = np.unique(rng.integers(-(2**62), 2**62, int(rng.integers(1, 80))))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(-(2**62), 2**62, int(rng.integers(0, 6)))]))
        both = len(np.intersect1d(x, y))
        start = ngramjoin.head(x[: ngramjoin.window_length(len(x), 80)], marks, len(x), 80)
        assert start is None or [*map(list, start[:1]), *start[1:]] == [*map(list, ngramjoin.head(x, marks, len(x), 80)[:1]), *ngramjoin.head(x, marks, len(x), 80)[1:]]
        hx, hy = ngramjoin.head(x, marks, len(x), 80), ngramjoin.head(y, marks, len(y), 80)
        assert len(hx[0]) == ngramjoin.head_length(len(x), 80)
        if both * 100 >= 80 * (len(x) + len(y) - both):
            shared = len(np.intersect1d(hx[0], hy[0]))
            assert shared
            # what the earlier end leaves possible is not below the true overlap
            n, h = (len(x), hx[0]) if hx[1:] <= hy[1:] else (len(y), hy[0])
            assert shared + n - len(h) >= both


@pytest.mark.parametrize("common,small", [(16, 16), (2, 2)])
def test_join_equals_brute_force(spark, monkeypatch, common, small):
    monkeypatch.setattr(ngramjoin, "COMMON", common)
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    rng = random.Random(common)
    passage = prose(rng, 50)
    texts = [t for g in range(6) for t in near_copies(rng, 12)]
    texts += [passage + " " + prose(rng, n) for n in (0, 1, 2, 3, 5, 8, 8, 20, 60, 200)]
    texts += [prose(rng, 3) for _ in range(5)] + ["a b c", "A  b\tc", "a b", "", None]
    rows = list(enumerate(texts))
    for threshold in (85, 60):
        assert joined(spark, rows, threshold=threshold) == brute_join(rows, threshold)


def test_join_finishes_large_keys_in_blocks(spark, monkeypatch):
    # every text holds the same boilerplate and little else: all heads share n-grams, few texts are linked
    monkeypatch.setattr(ngramjoin, "COMMON", 2)
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    rng = random.Random(4)
    boiler = prose(rng, 40)
    rows = [(i, f"{boiler} {prose(rng, rng.randint(0, 9))} {i % 9}") for i in range(60)]
    for threshold in (85, 97):
        got = joined(spark, rows, threshold=threshold)
        assert got == brute_join(rows, threshold)
    assert len({r[2] for r in got}) > 5


def test_join_odd_rows(spark):
    got = ngramjoin.similar_components(docs_of(spark, ODD).selectExpr("*", "text AS component_id")).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got)
    assert found == [(False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 1, 4), (False, 4, 1, 4), (False, 7, 1, 7), (True, 0, 1, None)]
    assert ngramjoin.similar_components(docs_of(spark, [])).count() == 0


# --- clustering


def brute_lloyd(rows, k, rounds, seed, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted((sha(f"{seed}:{i}"), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        for j, vs in of.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    return sorted((i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, centroids[j])))) for i, j, d in out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'x' AS cluster", "1 AS id")


@pytest.mark.parametrize("n,k,spread", [(200, 8, 1.0), (40, 3, 0.01), (5, 8, 1.0), (60, 4, 3e9)])
def test_lloyd_equals_brute_force(spark, n, k, spread):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, spread) for _ in range(3)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(10)]  # repeated vectors: ties and empty clusters
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [None, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0])]
    got = clustering.lloyd(vectors_of(spark, rows), k=k, rounds=4, seed=3, dims=3)
    limit = lambda r: tuple(min(x, 2**63 - 1) if isinstance(x, int) else x for x in r)
    assert sorted(map(tuple, got.collect())) == sorted(map(limit, brute_lloyd(rows, k, 4, 3, 3)))


def test_lloyd_odd_rows(spark):
    assert clustering.lloyd(vectors_of(spark, []), dims=3).collect() == []
    got = clustering.lloyd(vectors_of(spark, [(None, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]), k=1, dims=3, rounds=1)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r.vec_id is None, r.cluster, r.distance) for r in got.collect()) == [(False, 0, 341**2), (False, 0, 341**2), (True, 0, 683**2)]


# --- ranked search


def brute_ranked(docs, items, k):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    split = [(i, tokens(t)) for i, t in docs]
    total, n = sum(len(ts) for _, ts in split), sum(bool(ts) for _, ts in split)
    df = {}
    for _, ts in split:
        for w in set(ts):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, ts in split:
            m = 10 + 90 * len(ts) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * ts.count(w) // (1000 * ts.count(w) + 8 * m)) for w in set(tokens(text)) if w in ts)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def ranks(spark, docs, items, **options):
    d = docs_of(spark, [(i, t, "en", "s") for i, t in docs])
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score")
    return sorted(tuple(r)[:4] for r in lexical.ranked(d, q, **options).collect())


def test_treaps_are_heaps_in_document_order():
    rng = np.random.default_rng(2)
    term = np.sort(rng.integers(0, 7, 500))
    doc = np.concatenate([np.arange((term == t).sum()) * 2 for t in range(8)])
    impact = rng.integers(0, 4, 500)
    t = lexical.Treaps(term, doc, impact, 8)

    def walk(node, lo, hi):
        if node < 0:
            return []
        assert lo < doc[node] < hi
        for child in (t.left[node], t.right[node]):
            assert child < 0 or impact[child] <= impact[node]
        return walk(t.left[node], lo, doc[node]) + [node] + walk(t.right[node], doc[node], hi)

    for x in range(8):
        assert walk(t.root[x], -1, 10**6) == np.flatnonzero(term == x).tolist()


@pytest.mark.parametrize("k,block,postings", [(10, 16_384, 2_000_000), (3, 40, 2_000_000), (10, 16_384, 300)])
def test_search_equals_brute_force(spark, k, block, postings):
    rng = random.Random(k + block)
    docs = [(i, prose(rng, rng.choice([1, 5, 30, 80]))) for i in range(200)] + [(500 + i, "the river stone") for i in range(30)]
    items = [(j, prose(rng, 12)) for j in range(15)] + [(50, "The RIVER"), (51, "unseen words"), (52, "quick"), (53, "the the stones!")]
    assert ranks(spark, docs, items, k=k, block=block, postings=postings) == brute_ranked(docs, items, k)


def test_search_leaves_most_documents_out():
    rng = np.random.default_rng(3)
    docs, weights = 20_000, np.array([9000, 4000, 60, 30])
    term = np.repeat(np.arange(4), [40, 400, 15_000, 19_000])
    doc = np.concatenate([np.sort(rng.choice(docs, n, replace=False)) for n in (40, 400, 15_000, 19_000)])
    impact = weights[term] * rng.integers(50, 900, len(term))
    found, scores, scored = lexical.Treaps(term, doc, impact, 4).search(np.arange(4), docs, 10, 1)
    total = np.bincount(doc, weights=impact, minlength=docs).astype(np.int64)
    wanted = np.lexsort((np.arange(docs), -total))[:10]
    assert found.tolist() == wanted.tolist() and scores.tolist() == total[wanted].tolist() and scored < docs / 10


def test_search_odd_rows_and_blocks_of_queries(spark, monkeypatch):
    docs = [(i, t) for i, t, _, _ in ODD] + [(8, "wörd\x00naïve it's"), (9, "Word " * 20_000)]
    items = [(1, "word x"), (2, None), (3, ""), (4, "WÖRD NAÏVE"), (4, "wörd"), (5, "naïve id it")]
    wanted = brute_ranked(docs, [(1, "word x"), (4, "WÖRD NAÏVE wörd"), (5, "naïve id it")], 10)
    assert ranks(spark, docs, items) == wanted and wanted
    monkeypatch.setattr(lexical, "QUERY_CHARS", 20)
    assert ranks(spark, docs, items) == wanted
    assert ranks(spark, [], items) == [] and ranks(spark, docs, []) == []
