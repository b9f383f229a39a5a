"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all documents, for all items at once.
2. Benchmark items are cut into passages; a randomised SVD of their TF-IDF matrix, computed over the
   passages' partitions, gives latent axes, for each block of items its own.
3. Every document is cut into overlapping passages, each projected on the axes and compared with all item
   passages by cosine (with the full TF-IDF norms of both passages). A passage that the axes hold in part only
   reaches no more than that part, so its threshold is a share of it. Passages of a document of which the axes hold
   less than ``COSINE`` are left out beforehand. What this search alone finds are copies
   stretched by words put in between.
4. Short and heavily cut copies share too little with a passage of fixed length. So the
   words are counted too: a copy has 60 % of the item's words, hence most of its rare ones. Texts with enough
   of them are looked through for windows of the item's own length (and half of it for insertions) that have
   enough of all its words. Every copy within such a window is a candidate, whatever the axes, the weights
   and the number of documents.
5. Candidates are checked on words: the longest common subsequence of the item and the document around the
   passage, and that of the item's answer (what follows a word for it, else the last sentence). So edited
   copies count, shared words do not. Items of fewer than ``LEAST_WORDS`` words have too little to compare:
   they are found where their words stand in a row. Each result says which search found it.

The documents are read twice, and nothing of them is shuffled but the result. Items are worked on in blocks of
at most about ``ITEMS`` items and ``PASSAGES`` passages; one reading searches all blocks, or ``AT_ONCE`` of them
where there are more, which bounds what each task holds.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import compress, filterfalse, repeat
from operator import methodcaller

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, bounded_batches, chunks

#: Words of half a passage (passages are two halves and overlap by one), step between an item's passages.
HALF, STEP = 12, 6
#: Latent axes, extra random directions, power iterations, items at a time.
AXES, EXTRA, POWERS, ITEMS = 224, 16, 2, 200
#: Blocks that one reading of the documents searches: about 5 MB of vectors each.
AT_ONCE = 16
#: Passages of a block's items, about: longer items make smaller blocks, so that the axes suffice.
PASSAGES = 1_600
#: Share of an item's words, the rarest first, by which texts are chosen for the look through their windows.
RAREST = 0.8
#: Part of what the axes hold of an item's passage that a candidate must reach, where that is less than ``COSINE``.
HELD = 0.5
#: Least cosine of a candidate; least share of an item's words in common order, alone or with the answer.
COSINE, ALONE, WITH_ANSWER, ANSWER = 0.3, 0.75, 0.6, 0.75
#: Items with fewer words are found as whole sequences of words only.
LEAST_WORDS = 5
#: Words (followed by a colon) that an item's answer comes after.
ANSWERS = re.compile(r"(?:\banswer|\bsolution|\ba)\s*:", re.IGNORECASE)
_MARKS = string.punctuation + "«»“”„‘’…–—"
#: A token without the marks around it.
_BARE = methodcaller("strip", _MARKS)


def item_words(text: str | None) -> list[str]:
    return [c for w in (text or "").lower().split() if (c := w.strip(_MARKS))]


def answer_length(text: str) -> int:
    """Words of an item's answer: what follows the last word for it, else the last sentence; 3 at least, no more than the item."""
    n = len(item_words(text))
    marks = list(ANSWERS.finditer(text))
    tail = text[marks[-1].end() :] if marks else re.split(r"[.?!]\s+", text.strip())[-1]
    k = len(item_words(tail))
    return min(n, max(3, k if 0 < k < n else -(-n // 4)))


class Vocabulary:
    """Number of a token, from 2 on; 1 for a word that the benchmark doesn't have, 0 for padding and marks alone.

    Only the benchmark's words are held: looking a token up anew costs less than a table of all tokens, which outgrows the caches.
    """

    def __init__(self, words: list[str]):
        self.base = {w: i + 2 for i, w in enumerate(words)} | {"": 0}

    def numbers(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        n = np.fromiter(map(self.base.get, tokens, repeat(1)), dtype=np.int32, count=len(tokens))
        # letters and digits alone have no marks around them
        marked = ~np.fromiter(map(str.isalnum, tokens), dtype=bool, count=len(tokens))
        n[marked] = np.fromiter(map(self.base.get, map(_BARE, compress(tokens, marked.tolist())), repeat(1)), dtype=np.int32)
        return n

    def held(self, text: str | None) -> list[int]:
        """The numbers of the benchmark's words that a text has, once each."""
        tokens = set((text or "").lower().split())
        found = self.base.keys() & tokens
        found |= self.base.keys() & set(map(_BARE, filterfalse(str.isalnum, tokens)))
        return [self.base[w] for w in found if w]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming; 1 equals nothing."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        if x > 1:
            at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = at.get(y)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - bin(row).count("1")


def item_passages(items: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(item, words) of every passage; the last one ends with the item."""
    out = []
    for i, words in enumerate(items):
        last = max(0, len(words) - 2 * HALF)
        out += [(i, words[s : s + 2 * HALF]) for s in sorted({*range(0, last, STEP), last})]
    return out


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """(documents that hold each of the words, from the third place on; documents with text), over all documents."""
    size = len(words) + 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, df, n = Vocabulary(words), np.zeros(size, dtype=np.int64), 0
        for pdf in batches:
            for t in pdf["t"]:
                df[vocabulary.held(t)] += 1
                n += 1
        df[0] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"w": at, "n": df[at]}).astype("int64")

    rows = docs.mapInPandas(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size)
    for r in rows:
        df[r["w"]] = r["n"]
    return df, int(df[0])


def outside_weight(idf: np.ndarray, df: np.ndarray) -> float:
    """Weight of a word that the benchmark lacks: the mean of the benchmark's words over their documents.

    It depends on how common words are, not on the number of documents.
    """
    return float((idf[2:] * df[2:]).sum() / df[2:].sum()) if df[2:].sum() else float(np.log(2))


def latent_axes(spark, passages: list[list[int]], idf: np.ndarray, axes: int = AXES) -> np.ndarray:
    """(words x axes) right singular vectors of the passages' TF-IDF matrix, by a randomised SVD.

    Each power step multiplies the matrix and its transpose with a thin matrix, partition by partition;
    partitions are few and their products no larger than words x axes.
    """
    width = min(axes + EXTRA, len(passages), len(idf))
    parts = max(1, min(8, len(passages) // 500))
    table = spark.createDataFrame([(p,) for p in passages], "p array<int>").repartition(parts)

    def product(basis: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(basis.shape)
            for pdf in batches:
                for p in pdf["p"]:
                    w = idf[p]
                    w = w / max(1e-9, np.sqrt((w * w).sum()))
                    np.add.at(out, p, w[:, None] * (w @ basis[p])[None, :])
            yield pd.DataFrame({"b": [out.tobytes()]})

        rows = table.mapInPandas(run, "b binary").collect()
        return sum((np.frombuffer(r["b"]).reshape(basis.shape) for r in rows), np.zeros(basis.shape))

    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(idf), width)))[0]
    for _ in range(POWERS):
        basis = np.linalg.qr(product(basis))[0]
    # Rayleigh-Ritz within the basis
    values, rotation = np.linalg.eigh(basis.T @ product(basis))
    order = np.argsort(-values)[: min(axes, width)]
    return basis @ rotation[:, order]


class Searcher:
    """What a task needs to find the items of one block in texts.

    ``items`` are word numbers of the block, ``answers`` the lengths of their answers, ``names`` the numbers of
    the block's words in the vocabulary of all.
    """

    def __init__(self, items, answers, ids, names, idf, axes):
        self.items, self.answers, self.ids, self.names = items, answers, ids, names
        self.vectors = (idf[:, None] * axes).astype(np.float32)
        self.square = (idf * idf).astype(np.float32)
        self.length = np.sqrt((self.vectors * self.vectors).sum(1))
        self.short = [i for i, words in enumerate(items) if len(words) < LEAST_WORDS]
        parts = item_passages([w if len(w) >= LEAST_WORDS else [] for w in items])
        self.owner = np.array([i for i, _ in parts], dtype=np.int64)
        rows = np.array([self.vectors[p].sum(0) for _, p in parts]).reshape(len(parts), self.vectors.shape[1])
        norms = np.array([np.sqrt(self.square[p].sum()) for _, p in parts]).reshape(-1)
        self.parts = (rows / np.maximum(norms, 1e-9)[:, None]).astype(np.float32).T
        held = (self.parts * self.parts).sum(0)
        # items that are found as whole sequences have an empty passage, which nothing is near to
        self.least = np.where(held > 0, np.minimum(COSINE, HELD * held), np.inf)
        self._index(idf)

    def _index(self, idf: np.ndarray) -> None:
        """For each word the items that have it among their rarest, and what a copy of an item needs of words."""
        posts, self.kinds, self.times, self.rare, self.need, self.rare_need = [], [], [], [], [], []
        for i, words in enumerate(self.items):
            if len(words) < LEAST_WORDS:
                self.kinds.append(None)
                self.times.append(None)
                self.rare.append(None)
                self.need.append(0)
                self.rare_need.append(2**40)  # never reached
                continue
            kinds, times = np.unique(words, return_counts=True)
            order = np.argsort(-idf[kinds], kind="stable")
            upto = np.cumsum(times[order])
            chosen = order[: int(np.searchsorted(upto, RAREST * len(words))) + 1]
            need = int(np.ceil(WITH_ANSWER * len(words) - 1e-9))
            # a copy lacks at most len - need words; it has the rest of the rarest
            self.kinds.append(kinds)
            self.times.append(times)
            self.rare.append(kinds[chosen])
            self.need.append(need)
            self.rare_need.append(int(times[chosen].sum()) - (len(words) - need))
            posts += [(int(w), i, int(n)) for w, n in zip(kinds[chosen], times[chosen], strict=True)]
        posts.sort()
        self.post = np.array(posts, dtype=np.int64).reshape(-1, 3)
        self.first_post = np.searchsorted(self.post[:, 0], np.arange(len(self.vectors) + 1))
        self.rare_need = np.array(self.rare_need)

    def sequences(self, numbers: list[np.ndarray], has: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of the short items whose words stand in a row in the text."""
        for i in self.short:
            words = np.array(self.items[i])
            for d in np.flatnonzero(has[:, words].all(1)):
                x = numbers[d]
                x = x[x > 0]  # what has no letter or digit is no word
                starts = np.flatnonzero(x[: len(x) - len(words) + 1] == words[0]) if len(x) >= len(words) else ()
                if any((x[s : s + len(words)] == words).all() for s in starts):
                    yield int(d), i

    def windows(self, numbers: list[np.ndarray], has: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of every window that has enough of the item's words; exact, no sample."""
        count = len(self.items)
        has = has.copy()
        has[:, :2] = False
        d, w = np.nonzero(has)
        first = self.first_post[w]
        n = self.first_post[w + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        sums = np.bincount(np.repeat(d, n) * count + self.post[at, 1], weights=self.post[at, 2], minlength=len(numbers) * count)
        enough = sums.reshape(len(numbers), count) >= self.rare_need
        member = np.zeros(len(self.vectors), dtype=bool)
        for d, item in zip(*np.nonzero(enough), strict=True):
            length = len(self.items[item])
            span, step = length + max(2, length // 2), max(1, length // 4)
            starts = None
            for kinds, need in ((self.rare[item], self.rare_need[item]), (self.kinds[item], self.need[item])):
                member[kinds] = True
                at = np.flatnonzero(member[numbers[d]])
                member[kinds] = False
                # grid places whose window, a step longer than a copy's span, has enough words
                grid = np.arange(0, len(numbers[d]), step) if starts is None else starts
                starts = grid[np.searchsorted(at, grid + span + step) - np.searchsorted(at, grid) >= need]
            for s in starts:
                yield int(d), int(item), int(s), int(s) + span + step

    def cosine(self, x: np.ndarray, item: int) -> float:
        """Best cosine of a window's words with a passage of the item."""
        norm = np.sqrt(self.square[x].sum())
        return float((self.vectors[x].sum(0) @ self.parts[:, self.owner == item]).max() / max(1e-9, norm))

    def regions(self, numbers: list[np.ndarray], best: dict) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Stretches of the texts around passages whose cosine with an item's passage reaches the threshold."""
        halves = [-(-len(x) // HALF) + 1 for x in numbers]  # one empty half behind each text
        flat = np.zeros(sum(halves) * HALF, dtype=np.int32)
        first = np.cumsum([0, *halves])
        for x, f in zip(numbers, first, strict=False):
            flat[f * HALF : f * HALF + len(x)] = x
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        doc_of = np.repeat(np.arange(len(numbers)), halves)
        if not self.parts.shape[1]:
            return regions
        # a projection is no longer than the passage's part in the block's words, each word counted as often as it stands
        inside = self.length[flat].reshape(-1, HALF).sum(1)
        square = self.square[flat].reshape(-1, HALF).sum(1)
        norms = np.maximum(np.sqrt(square[:-1] + square[1:]), 1e-9)
        able = np.flatnonzero(inside[:-1] + inside[1:] >= COSINE * norms)
        where = np.zeros(len(square), dtype=np.int64)
        for lo in range(0, len(able), 1024):
            mine = able[lo : lo + 1024]
            half = np.unique(np.concatenate([mine, mine + 1]))
            where[half] = np.arange(len(half))
            part = flat.reshape(-1, HALF)[half]
            sums = np.einsum("hwk->hk", self.vectors[part])
            x = sums[where[mine]] + sums[where[mine + 1]]
            norm = norms[mine]
            long = np.flatnonzero((x * x).sum(1) >= (COSINE * norm) ** 2)
            if not len(long):
                continue
            x, norm, mine = x[long], norm[long], mine[long]
            for c in range(0, self.parts.shape[1], 4096):
                cos = (x @ self.parts[:, c : c + 4096]) / norm[:, None]
                for a, p in zip(*np.nonzero(cos >= self.least[c : c + 4096]), strict=True):
                    h = int(mine[a])
                    d, item = int(doc_of[h]), int(self.owner[c + p])
                    n, s = len(self.items[item]), (h - int(first[d])) * HALF
                    region = max(0, s - n), s + 2 * HALF + n
                    kept = regions.setdefault((d, item), [])
                    if kept and kept[-1][1] >= region[0] >= kept[-1][0]:
                        kept[-1] = kept[-1][0], max(kept[-1][1], region[1])
                    else:
                        kept.append(region)
                    best[d, item] = max(best.get((d, item), 0.0), float(cos[a, p]))
        return regions

    def search(self, everywhere: list[np.ndarray], place: np.ndarray) -> list[tuple]:
        """(text, item id, cosine, share of the item's words, share of the answer's, found by) of contaminated texts.

        ``everywhere`` are the texts as numbers of the whole vocabulary, ``place`` those of this block.
        """
        numbers = [place[x] for x in everywhere]
        has = np.zeros((len(numbers), len(self.vectors)), dtype=bool)
        for d, x in enumerate(numbers):
            has[d, x] = True
        out = [(d, self.ids[i], 1.0, 1.0, 1.0, "sequence") for d, i in self.sequences(numbers, has)]
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, item, s, e in self.windows(numbers, has):
            windows.setdefault((d, item), []).append((s, e))
        best: dict[tuple[int, int], float] = {}
        regions = self.regions(numbers, best)
        for d, item in sorted({*regions, *windows}):
            words = self.items[item]
            answer = words[-self.answers[item] :]
            found = latent = (0.0, 0.0)
            for s, e in windows.get((d, item), ()):
                near = numbers[d][s:e].tolist()
                share = common_subsequence(words, near) / len(words)
                tail = common_subsequence(answer, near) / len(answer) if share >= WITH_ANSWER else 0.0
                if (share, tail) > found:
                    found = (share, tail)
                    if share >= WITH_ANSWER:
                        best[d, item] = max(best.get((d, item), 0.0), self.cosine(numbers[d][s:e], item))
            for s, e in regions.get((d, item), ()):
                # a long region is read in pieces; whatever lies within four times the item, or near one passage, is whole in one
                lap = max(4 * len(words), 2 * HALF + 2 * len(words))
                size = 2 * lap
                for at in range(s, max(s + 1, e - lap), lap):
                    piece = numbers[d][at : min(e, at + size)]
                    # no more words in common order than there are in common
                    if not self._enough(piece, item):
                        continue
                    near = piece.tolist()
                    share = common_subsequence(words, near) / len(words)
                    tail = common_subsequence(answer, near) / len(answer) if share >= WITH_ANSWER else 0.0
                    latent = max(latent, (share, tail))
            by = [name for name, (share, tail) in (("windows", found), ("latent", latent)) if share >= ALONE or share >= WITH_ANSWER and tail >= ANSWER]
            if by:
                out.append((d, self.ids[item], best[d, item], *max(found, latent), "+".join(by)))
        return out

    def _enough(self, piece: np.ndarray, item: int) -> bool:
        times = np.bincount(piece, minlength=len(self.vectors))[self.kinds[item]]
        return int(np.minimum(times, self.times[item]).sum()) >= self.need[item]


class Search:
    """Several blocks' searchers over one vocabulary: what one reading of the documents looks for."""

    def __init__(self, words: list[str], blocks: list[Searcher]):
        self.words, self.blocks = words, blocks

    def __call__(self, batches: Iterator[tuple[list, list]]) -> Iterator[tuple]:
        """From (keys, texts) to (key, item id, cosine, words, answer)."""
        vocabulary = Vocabulary(self.words)
        places = []
        for block in self.blocks:
            place = np.ones(len(self.words) + 2, dtype=np.int32)
            place[0] = 0
            place[block.names] = np.arange(2, len(block.names) + 2)
            places.append(place)
        for keys, texts in batches:
            numbers = [vocabulary.numbers(t) for t in texts]
            for block, place in zip(self.blocks, places, strict=True):
                for d, *rest in block.search(numbers, place):
                    yield keys[d], *rest


def searches(texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, block: int, at_once: int = AT_ONCE) -> Iterator[Search]:
    """Searches for all of the benchmark's items, ``at_once`` blocks each; ``texts`` has the documents' texts as ``t``.

    The benchmark's items come to the driver, ``at_once`` blocks at a time: benchmarks do not grow with documents.
    """
    rows = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    # blocks of items by a hash, sized by counts of items and of their passages
    over = F.greatest(F.size(F.split(F.trim("t"), r"\s+")) - 2 * HALF, F.lit(0))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(1 + F.ceil(over / STEP)), F.lit(0)).alias("p")).first()
    blocks = max(-(-size["n"] // block), -(-int(size["p"]) // PASSAGES))
    number = F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks))).alias("b")
    for lo in range(0, blocks, at_once):
        part = rows.select("i", "t", number).where((F.col("b") >= lo) & (F.col("b") < lo + at_once)).orderBy("b", "i", "t").collect()
        found = [(r["b"], r["i"], w, answer_length(r["t"])) for r in part if (w := item_words(r["t"]))]
        if not found:
            continue
        words = sorted({w for _, _, ws, _ in found for w in ws})
        df, n = document_frequencies(texts, words)
        every = np.log((n + 2) / (df + 1))
        every[0], every[1] = 0.0, outside_weight(every, df)  # padding; words that the benchmark doesn't have
        at = {w: i + 2 for i, w in enumerate(words)}
        made = []
        for b in sorted({f[0] for f in found}):
            mine = [f for f in found if f[0] == b]
            names = np.array(sorted({at[w] for _, _, ws, _ in mine for w in ws}), dtype=np.int64)
            own = {int(x): i + 2 for i, x in enumerate(names)}
            items = [[own[at[w]] for w in ws] for _, _, ws, _ in mine]
            # words of other blocks weigh as what the block lacks
            idf = np.concatenate([every[:2], every[names]])
            parts = [p for _, p in item_passages([w for w in items if len(w) >= LEAST_WORDS])]
            axes = latent_axes(texts.sparkSession, parts, idf) if parts else np.zeros((len(idf), 1))
            axes[:2] = 0
            made.append(Searcher(items, [a for *_, a in mine], [i for _, i, _, _ in mine], names, idf, axes))
        yield Search(words, made)


def _pieces(batches: Iterator[pd.DataFrame], key) -> Iterator[tuple[list, list]]:
    for pdf in batches:
        for piece in chunks(pdf, "t", chars=300_000):
            yield key(piece), list(piece["t"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = ITEMS, at_once: int = AT_ONCE) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, cosine, words, answer, found_by.

    found_by is windows, latent, both (windows+latent) or sequence. words and answer are the shares of the item's words, and of its answer's, that the document has in
    order near the passage. Items with a null text or without words are never found; items of fewer than
    ``LEAST_WORDS`` words where these stand in a row; of items with equal texts each is reported. Documents
    with a null text hold nothing; repeated rows are reported each; an empty table gives no rows.
    """
    bounded_batches(docs)
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(benchmark.dtypes)[item_id]}, cosine double, words double, answer double, found_by string"
    out = docs.sparkSession.createDataFrame([], schema)
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    for search in searches(texts.select("t"), benchmark, item_id, item_text, block, at_once):

        def find(batches: Iterator[pd.DataFrame], search=search) -> Iterator[pd.DataFrame]:
            hits = []
            for hit in search(_pieces(batches, lambda p: p["id"].tolist())):
                hits.append(hit)
                if len(hits) == 1000:
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id", "cosine", "words", "answer", "found_by"])
                    hits = []
            if hits:
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "cosine", "words", "answer", "found_by"])

        out = out.unionByName(texts.mapInPandas(find, schema))
    return out


def _clean(search: Search):
    """Column function: whether a text holds none of the items."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            frame = pd.DataFrame({"t": column.reset_index(drop=True)})
            held = {d for d, *_ in search(_pieces([frame], lambda p: p.index.tolist()))}
            yield pd.Series([d not in held for d in range(len(frame))], dtype=bool)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = ITEMS, at_once: int = AT_ONCE) -> DataFrame:
    """The rows whose text holds no item, with their columns.

    Each row is judged by its own text and by nothing else: ids may be missing or repeated, they are not
    read. A null text stays.
    """
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("t"))
    for i, search in enumerate(searches(texts, benchmark, item_id, item_text, block, at_once)):
        # written between readings: one worker holds one search
        docs = (scratch.keep(docs) if i else docs).where(_clean(search)(F.col(f"`{text}`")))
    return docs
