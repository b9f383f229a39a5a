"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; most faults are seen by two of them or
more. Expectation-maximisation estimates, without any true labels, how often each labeller votes what on good and on
bad documents, false objections of good ones included. Bad documents are so in one of a few ways (latent classes), and votes are
independent given the way, which is how labellers may overlap; the number of ways is the one with the best
Bayesian information criterion. It needs only how often each combination of votes occurs, which is counted over all documents and is
bounded by 3 to the number of labellers. The posterior labels train a hashed linear scorer on ``SAMPLE``
distinct texts chosen by hash; every document is scored, from its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import bounded_batches, cut_for, key_names, place

#: Buckets of the hashed features; documents that the scorer is fitted on.
BUCKETS, SAMPLE = 2048, 6000
#: Flat prior of each estimate, in votes of each kind: the same at every size of the table.
PRIOR = 0.5
#: Ways of being bad at most.
WAYS = 8
#: Fixed values, the labellers: (name, bad from this share on, good up to this share); between: no vote.
SHARES = [
    ("noise", 0.30, 0.05),  # words that end in two or more symbols
    ("capitals", 0.50, 0.15),  # words in capitals
    ("bars", 0.08, 0.01),  # words without letter or digit
    ("echo", 0.20, 0.05),  # words equal to the word before
    ("repeated", 0.70, 0.50),  # words that occurred before
    ("lines", 0.50, 0.20),  # lines that occurred before
    ("long", 0.10, 0.02),  # words of more than 30 characters
    ("digits", 0.30, 0.10),  # words with a digit
    ("marks", 0.08, 0.02),  # words that end in a symbol that is no punctuation
]
LABELLERS = len(SHARES) + 1  # and one on sentence ends
#: Marks that words of prose end in.
PUNCTUATION = ".,;:!?)]}\"'’”»…-"
_RUNS = re.compile(r"([^\W\d_]+|\d+|\s+)|(.)\2*")


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as A, a and 0; symbols once, or twice for a run."""
    def one(m: re.Match) -> str:
        run = m.group(0)
        if m.group(2):
            return m.group(2) if len(run) == 1 else m.group(2) * 2
        return "A" if run[0].isupper() else "0" if run[0].isdigit() else "a"

    return _RUNS.sub(one, word)


class Profiler:
    """Votes and hashed features of texts; keeps what it knows of words, in bounded memory."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, 8), dtype=np.int64)
        self.plain: dict[tuple, tuple] = {}

    def _facts(self, word: str) -> tuple:
        core = word.rstrip(".,;:!?%$&*#|")
        if core.isalpha() and len(word) - len(core) < 9:
            # words of letters alone, with or without marks behind: what counts is their case and the marks
            kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "?"
            key = kind, word[len(core) :], min(len(core), 2), len(word) > 30
            got = self.plain.get(key) if kind != "?" else self._slow_facts(word)
            if got is None:
                got = self.plain[key] = self._slow_facts(word)
            return got
        return self._slow_facts(word)

    def _slow_facts(self, word: str) -> tuple:
        letters = sum(c.isalpha() for c in word)
        noise = len(word) >= 2 and not word[-1].isalnum() and word[-2] == word[-1]
        capitals = letters >= 2 and word.upper() == word and word.lower() != word
        bare = not any(c.isalnum() for c in word)
        h = xxhash.xxh32_intdigest(shape(word).encode("utf-8", "surrogatepass"))
        marked = not word[-1].isalnum() and word[-1] not in PUNCTUATION
        return noise, capitals, bare, len(word) > 30, any(c.isdigit() for c in word), word[-1] in ".?!;:", marked, h

    def profile(self, text: str | None, features: bool = True) -> tuple[int, np.ndarray, bool]:
        """(combination of votes in base 3, feature vector, whether there is a word)."""
        words = (text or "").split()
        if not words:
            return 0, np.zeros(BUCKETS, np.float32), False
        if len(self.index) > 100_000:
            self.clear()
        for w in set(words).difference(self.index):
            at = self.index[w] = len(self.index)
            if at == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at] = self._facts(w)
        ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        uniq, inverse = np.unique(ids, return_inverse=True)
        known = self.table[uniq]
        counts = np.bincount(inverse)
        n = len(words)
        share = counts @ known[:, :7] / n
        echo = (ids[1:] == ids[:-1]).sum() / max(1, n - 1)
        repeated = 1 - len(uniq) / n
        lines = [x for x in text.split("\n") if x.strip()]
        again = 1 - len(set(lines)) / max(1, len(lines))
        # a long text repeats words anyway: what counts is beyond the usual growth of a vocabulary
        repeated = max(0.0, 1 - len(uniq) / min(n, 12 * n**0.6)) if n >= 10 else 0.0
        values = [share[0], share[1], share[2], echo, repeated, again, share[3], share[4], share[6]]
        code = 0
        for v, (_, bad, good) in zip(values, SHARES, strict=True):
            code = code * 3 + (1 if v >= bad else 2 if v <= good else 0)
        code = code * 3 + (0 if n < 15 else 2 if 0.02 <= share[5] <= 0.35 else 1)
        if not features:
            return code, np.zeros(0, np.float32), True
        shapes = known[inverse, 7]
        pairs = (shapes[:-1] * 31 + shapes[1:] * 17) % 1_000_003
        marks = [int(v * 10) + 20 * i for i, v in enumerate([*values, share[5]])]
        tf = np.bincount(shapes % BUCKETS, minlength=BUCKETS) + np.bincount((pairs + 7) % BUCKETS, minlength=BUCKETS)
        x = np.log1p(tf.astype(np.float32))
        x /= max(1e-9, float(np.sqrt((x * x).sum())))
        for m in marks:
            x[(m * 7919 + 13) % BUCKETS] += 0.5
        return code, x, True


def unpack(code: int, k: int = LABELLERS) -> list[int]:
    """Votes: 0 none, 1 bad, 2 good."""
    return [code // 3 ** (k - 1 - i) % 3 for i in range(k)]


def _fit_ways(votes: np.ndarray, w: np.ndarray, ways: int, rounds: int) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(log likelihood, posterior of good, posterior of each class) with so many ways of being bad; None if there are not so many.

    Starts with the documents that at most one labeller objects to as good. The others are dealt to the most frequent combinations of
    objections that differ most, each the start of a way.
    """
    bad = votes == 1
    several = bad.sum(1) > 1 if (bad.sum(1) > 1).any() else bad.any(1)
    rest = np.flatnonzero(several)
    if len(rest) < ways:
        return None
    seeds = [rest[np.argmax(w[rest])]]
    apart = lambda i: (bad[rest] != bad[i]).sum(1)
    while len(seeds) < ways:
        far = np.min([apart(i) for i in seeds], axis=0)
        if not far.max():
            return None
        seeds.append(rest[np.argmax(far * w[rest])])
    post = np.zeros((len(w), ways + 1))
    post[~several, 0] = 1
    post[rest, 1 + np.argmin([apart(i) for i in seeds], axis=0)] = 1
    post = 0.98 * post + 0.02 / (ways + 1)
    onehot = np.stack([votes == v for v in range(3)], axis=2).astype(np.float64)
    for _ in range(rounds):
        mass = w[:, None] * post
        table = np.einsum("nc,nkv->ckv", mass, onehot) + PRIOR
        table /= table.sum(2, keepdims=True)
        share = (mass.sum(0) + PRIOR) / (w.sum() + PRIOR * (ways + 1))
        ll = np.log(share)[None, :] + np.einsum("nkv,ckv->nc", onehot, np.log(table))
        top = ll.max(1, keepdims=True)
        new = np.exp(ll - top)
        total = new.sum(1, keepdims=True)
        new /= total
        done = float(np.abs(new - post).max()) < 1e-9
        post = new
        if done:
            break
    good = int(np.argmin(table[:, :, 1].sum(1)))  # the class that labellers object to least
    return float((w * (np.log(total) + top)[:, 0]).sum()), post[:, good], post


def expectation_maximisation(counts: dict[int, int], rounds: int = 200, k: int = LABELLERS) -> tuple[dict[int, float], float, np.ndarray]:
    """(posterior of good by combination, share of good documents, P(vote | class) by labeller, class, vote).

    Class 1 is good, class 0 bad in any way. The number of ways, up to ``WAYS``, has the best information criterion. The prior
    (``PRIOR``) is the same at every size, no probability is held to a range. Deterministic.
    """
    codes = sorted(c for c, n in counts.items() if n > 0)
    if not codes:
        return {}, 0.5, np.full((k, 2, 3), 1 / 3)
    votes = np.array([unpack(c, k) for c in codes]).reshape(len(codes), k)
    w = np.array([counts[c] for c in codes], dtype=np.float64)
    best, p_good = np.inf, np.ones(len(codes))
    for ways in range(1, WAYS + 1):
        fit = _fit_ways(votes, w, ways, rounds)
        if fit is None:
            break
        criterion = ((2 * k + 1) * (ways + 1) - 1) * np.log(w.sum()) - 2 * fit[0]
        if criterion < best:
            best, p_good = criterion, fit[1]
    onehot = np.stack([votes == v for v in range(3)], axis=2).astype(np.float64)
    out = np.full((k, 2, 3), 1 / 3)
    for c, p in ((0, 1 - p_good), (1, p_good)):
        out[:, c] = np.einsum("n,nkv->kv", w * p, onehot) + PRIOR / 3
    out /= out.sum(2, keepdims=True)
    return dict(zip(codes, p_good.tolist(), strict=True)), float((w * p_good).sum() / w.sum()), out


def fit_scorer(X: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; the two classes weigh the same. Full-batch, accelerated, deterministic.

    ``X`` is multiplied in its own precision: a wider copy in every round would be twice as large as the sample.
    """
    w, b = np.zeros(X.shape[1]), 0.0
    if not len(X):
        return w, b
    good, bad = max(1e-6, y.sum()), max(1e-6, (1 - y).sum())
    weight = y / good + (1 - y) / bad
    weight /= weight.sum()
    v, vb = w.copy(), b
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ v.astype(X.dtype) + vb, -30, 30)))
        g = weight * (p - y)
        nw, nb = v - rate * (X.T @ g.astype(X.dtype) + ridge * v), vb - rate * g.sum()
        m = t / (t + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    profiler, counts = Profiler(), Counter()
    for pdf in batches:
        for text in pdf["t"]:
            code, _, any_word = profiler.profile(text, features=False)
            counts[code] += any_word
    yield pd.DataFrame({"code": list(counts), "n": list(counts.values())}).astype("int64")


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    profiler = Profiler()
    for pdf in batches:
        # big-endian bytes: small on the driver, and they sort as the numbers do
        rows = [(h, c, np.flatnonzero(x).astype(">i4").tobytes(), x[x > 0].astype(">f4").tobytes()) for h, (c, x, ok) in zip(pdf["h"], map(profiler.profile, pdf["t"]), strict=True) if ok]
        if rows:
            yield pd.DataFrame(rows, columns=["h", "code", "at", "x"])


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """Posterior by combination of votes, weights and bias.

    The scorer learns from at most ``sample`` distinct texts, those with the smallest hashes: copies of a
    text are one example, so its number and the result do not depend on how often rows repeat.
    """
    bounded_batches(docs)
    texts = docs.select(F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull())
    rows = texts.mapInPandas(_votes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = {r["code"]: r["n"] for r in rows if r["n"]}
    posterior, prior, table = expectation_maximisation(counts)
    at = place(F.col("t"))
    chosen = texts.select("t", at.alias("h")).where(F.col("h") < cut_for(texts, at, sample))
    # in the range are a quarter more texts than the sample; copies have the same features
    found = chosen.mapInPandas(_examples, "h long, code long, at binary, x binary").groupBy("h").agg(F.min(F.struct("code", "at", "x")).alias("e"))
    got = sorted(((r["h"], r["e"]) for r in found.collect()), key=lambda r: r[0])[:sample]
    X, y = np.zeros((len(got), BUCKETS), np.float32), np.zeros(len(got))
    for i, (_, e) in enumerate(got):
        X[i, np.frombuffer(e["at"], ">i4")] = np.frombuffer(e["x"], ">f4")
        y[i] = posterior.get(e["code"], prior)
    weights, bias = fit_scorer(X, y)
    return {"posterior": posterior, "prior": prior, "table": table, "weights": weights.astype(np.float32), "bias": float(bias)}


def classify(docs: DataFrame, keys: dict[str, Column], text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row for each document: the ``keys`` columns (``_in`` behind the name of a result column), score, posterior, kept.

    score is the scorer's probability of a good document, posterior that of the labellers, kept is score
    >= threshold. A null text or one without words has score and posterior 0 and is not kept. Repeated
    rows get a row each. Other columns are carried only if they are keys.
    """
    model = train(docs, text, sample)
    posterior, prior, weights, bias = model["posterior"], model["prior"], model["weights"], model["bias"]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(keys.values())], F.col(f"`{text}`").alias("t"))
    results = {"score": "double", "posterior": "double", "kept": "boolean"}
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{k} {t}" for k, t in results.items()])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler = Profiler()
        for pdf in batches:
            s, q = [], []
            for t in pdf["t"]:
                code, x, ok = profiler.profile(t)
                s.append(float(1 / (1 + np.exp(-np.clip(float(x @ weights) + bias, -30, 30)))) if ok else 0.0)
                q.append(posterior.get(code, prior) if ok else 0.0)
            out = pdf.drop(columns="t")
            out["score"], out["posterior"] = s, q
            out["kept"] = np.array(s) >= threshold
            yield out

    out = rows.mapInPandas(score, schema)
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(key_names(keys, results))], *results)


def filter_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their columns; no join, texts are not shuffled."""
    named = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = classify(docs, named, text=text, **options).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
