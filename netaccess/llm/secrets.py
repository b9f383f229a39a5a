"""Secret scan: fixed patterns, plus spans tagged by a linear-chain conditional random field.

The field tags words as begin, inside or outside of a secret from their shape, the words around them and
features of the document. It is trained here, by maximum likelihood (forward-backward), on stretches of words
from anywhere in a bounded sample of distinct documents whose pattern spans are the labels. The patterns must not be all
that it learns: each stretch with a secret is learned a second time with what the patterns go by left out (the
words around it and how the secret starts), so that the shape alone tells. It is decoded by Viterbi over whole
documents. ``held_out_recall`` tells how it finds secrets of a kind that it has not seen.

Decoding is exact and cheap: where a word's score for "outside" leads by more than transitions could ever
make up, every best path is outside there, so a document falls into short stretches of undecided words
and only these are decoded word by word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import WORD, bounded_batches, cut_for, place

#: The patterns, in the order in which kinds are listed. Long forms of hex and access runs
#: match exactly the long ones among all maximal runs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
HINTS = ("passw", "secret", "token", "api")
OUT, BEGIN, INSIDE = 0, 1, 2
#: Hashed features; documents that the field is trained on, with and without spans; words around a span.
BUCKETS, SAMPLE, CONTEXT = 4096, 800, 12
#: Stretches of the sample, those with the smallest hashes, that the field is fitted on.
STRETCHES = 6_000
_WORD = re.compile(WORD)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start and kind; code points, end exclusive."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def value_spans(text: str, kinds=KINDS) -> list[tuple[int, int]]:
    """The secrets' own ranges: what the field learns to tag."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "assign" in kinds else []
    return sorted([*found, *((s, e) for s, e, k in base_spans(text) if k != "assign" and k in kinds)])


def _bucket(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> tuple[list[int], int, int]:
    """(buckets of the word's own features, bucket as the word before, bucket as the word after)."""
    core = word.strip("\"'.,;:()[]{}<>")
    n = len(core)
    digits, uppers = sum(c.isdigit() for c in core), sum(c.isupper() for c in core)
    hexes = sum(c in "0123456789abcdef" for c in core)
    odd = sum(not c.isalnum() for c in core)
    distinct = len(set(core))
    size = "0" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 24 else "24"
    mix = f"{digits > 0}{uppers > 1}{0 < uppers < n}{odd > 0}"
    # what tells a random run of characters from words and numbers: changes between letters and digits, and how many letters are vowels
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    odds = f"{size}{min(4, turns // 2)}{distinct >= 10}"
    own = ["s" + size, f"t{odds}", f"d{size}{4 * digits // max(1, n)}", f"e{distinct >= 10}{size}", "sm" + size + mix, f"h{n >= 12 and hexes == n}", f"q{word[:1] in chr(34) + chr(39)}", "p" + (core[:4] if n >= 16 and digits else "")]
    plain = "a" if core.isalpha() and n < 20 else "n" if core.isdigit() else "x"
    key = core.lower() if core.lower() in NAMES else word if n == 0 else plain
    return [_bucket(x) for x in own], _bucket("<" + key), _bucket(">" + plain)


#: Words that name secrets.
NAMES = {"password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "bearer", "access"}


#: So many of a word's own features, the first, go by shape alone.
SHAPES = 4


def document_feature(text: str) -> int:
    """Bucket of the document's own features: length class, and whether it has assignments."""
    return _bucket(f"doc{min(4, len(text).bit_length() // 3)}{' = ' in text}")


class Lexicon:
    """Emission scores of words, kept by word in bounded memory: own, as word before and as word after."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.rows: dict[tuple, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, 9), dtype=np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words x 3) scores without the document's feature."""
        if len(self.index) > 100_000:
            self.clear()
        w = self.weights
        for word in set(words).difference(self.index):
            at = self.index[word] = len(self.index)
            if at == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at] = self._cached(word)
        ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        t = self.table[ids]
        out = t[:, :3].copy()
        out[1:] += t[:-1, 3:6]
        out[:-1] += t[1:, 6:9]
        out[0] += w[_bucket("<^")]
        out[-1] += w[_bucket(">$")]
        return out

    def _cached(self, word: str) -> np.ndarray:
        """The row of a word; common words in lower case or capitalised share rows with their like."""
        core = word.strip("\"'.,;:()[]{}<>")
        n = len(core)
        if 1 < n < 12 and core.isalpha() and core[1:].islower() and word[0] not in "\"'":
            lower = core[0].islower()
            if (lower or core[0].isupper()) and core.lower() not in NAMES:
                key = n >= 8, lower, n >= 10 and len(set(core)) >= 10
                row = self.rows.get(key)
                if row is None:
                    row = self.rows[key] = self._row(word)
                return row
        return self._row(word)

    def _row(self, word: str) -> np.ndarray:
        own, before, after = features(word)
        return np.concatenate([self.weights[own].sum(0), self.weights[before], self.weights[after]])


def viterbi(emission: np.ndarray, transition: np.ndarray) -> list[int]:
    """The best tags; the chain starts and ends outside (what is beyond it is outside)."""
    score = transition[OUT] + emission[0]
    back = []
    for e in emission[1:]:
        step = score[:, None] + transition
        back.append(step.argmax(0))
        score = step.max(0) + e
    tag = int((score + transition[:, OUT]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


def decode(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Viterbi of the whole chain, with words split off that are certainly outside."""
    allowed = transition[transition > -1e5]
    margin = 2 * float(allowed.max() - allowed.min())
    sure = emission[:, OUT] - emission[:, 1:].max(1) > margin
    tags = np.zeros(len(emission), dtype=np.int8)
    open_ = np.flatnonzero(~sure)
    if len(open_):
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[run] = viterbi(emission[run], transition)
    return tags


def train(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by bucket and tag, transitions) from (buckets of each word, tags); AdaGrad on the likelihood."""
    W, T = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    T[OUT, INSIDE] = -1e6
    if not sequences:
        W[:, OUT] = 1.0
        return W.astype(np.float32), T
    N, L, K = len(sequences), max(len(t) for _, t in sequences), max(len(f) for x, _ in sequences for f in x)
    at, tags, mask = np.full((N, L, K), BUCKETS), np.zeros((N, L), dtype=np.int64), np.zeros((N, L), dtype=bool)
    for i, (x, t) in enumerate(sequences):
        tags[i, : len(t)], mask[i, : len(t)] = t, True
        for j, f in enumerate(x):
            at[i, j, : len(f)] = f
    gold = np.zeros((BUCKETS + 1, 3))
    np.add.at(gold, (at[mask].ravel(), np.repeat(tags[mask], K)), 1)
    gold_t = np.zeros((3, 3))
    before = np.concatenate([np.zeros((N, 1), dtype=np.int64), tags[:, :-1]], 1)
    np.add.at(gold_t, (before[mask], tags[mask]), 1)
    length = mask.sum(1)
    np.add.at(gold_t, (tags[np.arange(N), length - 1], np.zeros(N, dtype=np.int64)), 1)
    gw, gt = np.full((BUCKETS, 3), 1e-3), np.full((3, 3), 1e-3)
    for _ in range(rounds):
        E = np.vstack([W, np.zeros((1, 3))])[at].sum(2)
        A, B = np.zeros((N, L, 3)), np.zeros((N, L, 3))
        A[:, 0] = T[OUT] + E[:, 0]
        for j in range(1, L):
            new = np.logaddexp.reduce(A[:, j - 1, :, None] + T, axis=1) + E[:, j]
            A[:, j] = np.where(mask[:, j, None], new, A[:, j - 1])
        B[:, L - 1] = T[:, OUT]
        for j in range(L - 2, -1, -1):
            new = np.logaddexp.reduce(T + (E[:, j + 1] + B[:, j + 1])[:, None, :], axis=2)
            B[:, j] = np.where(mask[:, j + 1, None], new, T[:, OUT])
        Z = np.logaddexp.reduce(A[:, L - 1] + T[:, OUT], axis=1)
        P = np.exp(A + B - Z[:, None, None]) * mask[..., None]
        expected = np.zeros((BUCKETS + 1, 3))
        for k in range(K):
            np.add.at(expected, at[:, :, k].ravel(), P.reshape(-1, 3))
        pair = np.exp(A[:, :-1, :, None] + T + (E[:, 1:] + B[:, 1:])[:, :, None, :] - Z[:, None, None, None]) * mask[:, 1:, None, None]
        expected_t = pair.sum((0, 1))
        expected_t[OUT] += P[:, 0].sum(0)
        expected_t[:, OUT] += P[np.arange(N), length - 1].sum(0)
        dw, dt = (gold - expected)[:BUCKETS] / N - ridge * W, (gold_t - expected_t) / N - ridge * np.clip(T, -50, 50)
        gw += dw * dw
        gt += dt * dt
        W += rate * dw / np.sqrt(gw)
        T += rate * dt / np.sqrt(gt)
        T[OUT, INSIDE] = -1e6
    return W.astype(np.float32), T


def sequences_of(text: str, kinds=KINDS) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Training sequences of a document: words around each of its spans, wherever they are, once as they are and once masked, and one stretch at a place by hash."""
    spans = value_spans(text, kinds)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if not words:
        return
    tags, at = [OUT] * len(words), 0
    for s, e in spans:
        inside = False
        while at > 0 and words[at - 1][1] > s:
            at -= 1
        while at < len(words) and words[at][0] < e:
            if words[at][1] > s and tags[at] == OUT:
                tags[at] = INSIDE if inside else BEGIN
                inside = True
            at += 1
    doc, last = document_feature(text), -1
    anywhere = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % len(words)
    hits = [i for i, t in enumerate(tags) if t == BEGIN]
    for h in sorted({*hits, anywhere}):
        lo, hi = max(0, h - CONTEXT), min(len(words), h + CONTEXT + 1)
        if lo <= last:
            lo = last + 1  # no word twice
            if lo >= hi or tags[lo] == INSIDE:
                continue
        last = hi - 1
        near = [text[a:b] for a, b in words[max(0, lo - 1) : hi + 1]]
        facts = [features(w) for w in near]
        off = lo - max(0, lo - 1)
        plain, masked = [], []
        for i in range(hi - lo):
            j = i + off
            before = facts[j - 1][1] if j else _bucket("<^")
            after = facts[j + 1][2] if j + 1 < len(facts) else _bucket(">$")
            plain.append([*facts[j][0], before, after, doc])
            masked.append([*facts[j][0][:SHAPES], doc])
        yield plain, tags[lo:hi]
        if any(tags[lo:hi]):
            yield masked, tags[lo:hi]


def _stretches(kinds):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, text in zip(pdf["h"], pdf["t"], strict=True):
                for n, (x, tags) in enumerate(sequences_of(text, kinds)):
                    rows.append((xxhash.xxh64_intdigest(f"{h}:{n}") >> 1, json.dumps([x, tags])))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["g", "x"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["g", "x"])

    return run


NAMED = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, kinds=KINDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, from ``sample`` distinct texts with pattern spans and as many of all, chosen by hash.

    Whole texts are read where they lie; what comes to the driver are at most ``STRETCHES`` stretches of
    25 words at most, as numbers. ``kinds`` are those whose spans are labels.
    """
    bounded_batches(docs)
    t = F.col(f"`{text}`")
    rows = docs.where(t.isNotNull()).select(t.alias("t"), place(t).alias("h"))
    got = {}
    for part in (rows.where(F.col("t").rlike(NAMED)), rows):
        cut = cut_for(part, F.col("h"), sample)
        # the range of the hash is tested first: the pattern meets few texts
        chosen = rows.where(F.col("h") < cut) if part is rows else rows.where(F.col("h") < cut).where(F.col("t").rlike(NAMED))
        found = chosen.mapInPandas(_stretches(kinds), "g long, x string").groupBy("g").agg(F.min("x").alias("x"))
        got |= {r["g"]: r["x"] for r in found.orderBy("g").limit(STRETCHES // 2).collect()}
    return train([(x, tags) for x, tags in (json.loads(got[g]) for g in sorted(got))])


def held_out_recall(docs: DataFrame, kind: str, text: str = "text", sample: int = SAMPLE) -> tuple[int, int]:
    """(found, all) secrets of a kind whose spans the field has not learned from: documents that have it are left out of the fit."""
    t = F.col(f"`{text}`")
    with_kind = {"assign": ASSIGN.pattern, "access": ACCESS.pattern, "hex": HEX.pattern}[kind]
    has = t.rlike(("(?i)" if kind == "assign" else "") + with_kind)
    weights, transition = fit(docs.where(t.isNotNull() & ~has), text, sample, tuple(k for k in KINDS if k != kind))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, hit, every = Lexicon(weights), 0, 0
        for pdf in batches:
            for x in pdf["t"]:
                spans = value_spans(x, (kind,))
                tagged = crf_spans(x, [], lexicon, transition, weights[document_feature(x)]) if spans else []
                every += len(spans)
                hit += sum(any(a < e and s < b for a, b, _ in tagged) for s, e in spans)
        yield pd.DataFrame({"hit": [hit], "every": [every]})

    r = docs.where(has).select(t.alias("t")).mapInPandas(count, "hit long, every long").agg(F.sum("hit"), F.sum("every")).first()
    return r[0] or 0, r[1] or 0


def crf_spans(text: str, base: list[tuple[int, int, str]], lexicon: Lexicon, transition: np.ndarray, document: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans that the field adds: runs of begin and inside that overlap no pattern span."""
    words = _WORD.findall(text)
    if not words:
        return []
    tags = decode(lexicon.scores(words) + document, transition)
    if not tags.any():
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out, i = [], 0
    while i < len(tags):
        if tags[i] == OUT:
            i += 1
            continue
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE:
            j += 1
        s, e = places[i][0], places[j - 1][1]
        while s < e and text[s] in "\"'([{<":
            s += 1
        while e > s and text[e - 1] in "\"').,;:]}>":
            e -= 1
        if s < e and not any(a < e and s < b for a, b, _ in base):
            out.append((s, e, "crf"))
        i = j
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, keys: dict[str, Column], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each document: the ``keys`` columns and n_assign, n_access, n_hex, base, spans.

    base lists the pattern spans, spans these and what the field adds, as kind:start:end by start, then
    kind. A null text is empty: no spans. Repeated rows get a row each, texts are read whole.
    """
    bounded_batches(docs)
    weights, transition = fit(docs, text, sample)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text}`").alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_assign long, n_access long, n_hex long, base string, spans string"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(weights)
        for pdf in batches:
            found = []
            for t in pdf["__t"]:
                t = t or ""
                base = base_spans(t)
                more = crf_spans(t, base, lexicon, transition, weights[document_feature(t)])
                kinds = [k for _, _, k in base]
                every = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
                found.append((*(kinds.count(k) for k in KINDS[:3]), digest(base), digest(every)))
            out = pdf.drop(columns="__t")
            for i, name in enumerate(("n_assign", "n_access", "n_hex", "base", "spans")):
                out[name] = [f[i] for f in found]
            yield out

    return rows.mapInPandas(find, schema)
