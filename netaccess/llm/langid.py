"""Language identification by hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with the letter itself. A
trigram is the product of its letters' vectors, the first rotated twice and the second once, so that
order matters; a text is the sum of its trigrams' vectors, a language the sum of its texts' unit
vectors. A text gets the language whose prototype has the largest cosine with it.

All is exact: unit vectors are rounded to integers before they are summed or multiplied, so sums don't depend on
partitioning, nor a cosine on the batch that a text comes in. Two passes over the texts, one small aggregation, no join, no shuffle of texts.
Prototypes are scored in blocks of ``BLOCK`` languages, one more pass for each further block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, bounded_batches, chunks, key_names

#: Dimension of the vectors, and the scale at which unit vectors become integers.
DIMS, SCALE = 512, 1_000_000
#: Grid that the components of both sides of a cosine are rounded to: products of such unit vectors sum exactly in a double.
GRID = 2**20
#: Trigram vectors that a worker keeps; beyond it the store starts anew (memory only, not results).
STORE = 30_000
#: Languages whose prototypes a worker holds at a time (4 KB each).
BLOCK = 1_000
#: Letters of a text that are encoded at a time.
PIECE = 500_000


def letter_vector(code: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(code + 7).integers(0, 2, dims, dtype=np.int8) * 2 - 1


class Encoder:
    """Texts to sums of trigram vectors; one for each Python worker."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.matrix = np.zeros((1024, self.dims), dtype=np.float32)

    def _letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = letter_vector(code, self.dims)
        return v

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of packed trigrams (21 bits a letter)."""
        if len(self.index) + len(grams) > STORE:
            self._clear()
        new = [g for g in grams.tolist() if g not in self.index]
        need = len(self.index) + len(new)
        if need > len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros((max(need, 2 * len(self.matrix)) - len(self.matrix), self.dims), np.float32)])
        for g in new:
            a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
            row = self.index[g] = len(self.index)
            self.matrix[row] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return self.matrix[[self.index[g] for g in grams.tolist()]]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(sum vectors, has a letter) of the texts; null is a text without letters."""
        lowered = ["" if t is None else t.lower() for t in texts]
        # each text stands between spaces; a long one is cut, and each piece starts with the two characters before it
        pieces = [" " + t + " " for t in lowered]
        if all(len(t) <= PIECE for t in pieces):
            return self._encode(pieces)
        out, has = np.zeros((len(texts), self.dims)), np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(pieces):
            for part in self._cuts(t):
                vectors, any_ = self._encode([part])
                out[i] += vectors[0]
                has[i] |= any_[0]
        return out, has

    def _cuts(self, text: str) -> Iterator[str]:
        """Pieces whose trigrams are together those of the text: runs of what is no letter count as one space across cuts."""
        before = ""
        for s in range(0, len(text), PIECE):
            part = re.sub(r"[\W\d_]+", lambda m: " " if not any(map(str.isalpha, m.group())) else "".join(c if c.isalpha() else " " for c in m.group()), text[s : s + PIECE])
            part = re.sub(" +", " ", part)
            if before.endswith(" "):
                part = part.lstrip(" ")
            yield before + part
            before = (before + part)[-2:]

    def _encode(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(spaced)
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(n), [len(t) for t in spaced])
        letter = self.is_letter[codes]
        has = np.zeros(n, dtype=bool)
        has[owner[letter]] = True
        keep = letter | ~np.concatenate([[False], ~letter[:-1]]) | np.concatenate([[True], owner[1:] != owner[:-1]])
        codes, owner = np.where(letter, codes, 32)[keep], owner[keep]
        if len(codes) < 3:
            return np.zeros((n, self.dims), np.float32), has
        alphabet = np.flatnonzero(np.bincount(codes))
        size = len(alphabet)
        small = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
        small[alphabet] = np.arange(size)
        s = small[codes]
        packed = (s[:-2] * size + s[1:-1]) * size + s[2:]
        packed, who = packed[owner[:-2] == owner[2:]], owner[:-2][owner[:-2] == owner[2:]]
        if size**3 <= 4_000_000:
            uniq = np.flatnonzero(np.bincount(packed, minlength=1))
            place = np.zeros(size**3, dtype=np.int64)
            place[uniq] = np.arange(len(uniq))
            at = place[packed]
        else:
            uniq, at = np.unique(packed, return_inverse=True)
        u = alphabet[uniq // (size * size)] << 42 | alphabet[uniq // size % size] << 21 | alphabet[uniq % size]
        out = np.zeros((n, self.dims), np.float32)
        for lo in range(0, len(u), 8192):  # bounded even for texts with huge alphabets
            part = (at >= lo) & (at < lo + 8192)
            width = min(8192, len(u) - lo)
            counts = np.bincount(who[part] * width + (at[part] - lo), minlength=n * width).reshape(n, width).astype(np.float32)
            out += counts @ self._rows(u[lo : lo + width])
        return out, has


def units(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Unit vectors times ``scale``, rounded to integers; each row's result depends on that row alone."""
    whole = vectors.astype(np.float64)
    norm = np.array([np.sqrt(float((row * row).sum())) for row in whole]).reshape(-1, 1)
    return np.rint(whole / np.where(norm > 0, norm, 1) * scale)


def _sums(examples: DataFrame, text: str, lang: str, dims: int) -> DataFrame:
    """(l, v): summed integer unit vectors of each language, from all rows with a lang and a letter in the text."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(dims), {}
        for pdf in batches:
            for part in chunks(pdf, "t"):
                vectors, has = encoder.encode(list(part["t"]))
                whole = units(vectors, SCALE).astype(np.int64)
                langs = part["l"].to_numpy()
                for value in set(langs[has]):
                    sums[value] = sums.get(value, 0) + whole[has & (langs == value)].sum(0)
            if len(sums) > 2000:  # bounded even where every row has a value of its own
                yield pd.DataFrame({"l": list(sums), "v": [v.tolist() for v in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({"l": list(sums), "v": [v.tolist() for v in sums.values()]})

    rows = examples.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    parts = rows.mapInPandas(partial, "l string, v array<long>")
    sums = parts.select("l", F.posexplode("v")).groupBy("l", "pos").agg(F.sum("col").alias("s"))
    found = sums.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("v"))
    return found.select("l", F.transform("v", lambda x: x["s"]).alias("v"))


def _learned(rows: list) -> list[tuple[str, np.ndarray]]:
    return sorted(((r["l"], units(np.array([r["v"]], dtype=np.float64), GRID)[0]) for r in rows), key=lambda x: x[0])


def prototypes(examples: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS, block: int = BLOCK) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Blocks of (lang, unit prototype times ``GRID``), about ``block`` languages each; at least one block, which may be empty."""
    sums = _sums(examples, text, lang, dims)
    n = examples.agg(F.approx_count_distinct(F.col(f"`{lang}`")).alias("n")).first()["n"]
    blocks = max(1, -(-n // block))
    if blocks == 1:
        yield _learned(sums.collect())
        return
    sums = Scratch(examples.sparkSession).keep(sums.withColumn("b", F.pmod(F.xxhash64("l"), F.lit(blocks))))
    for b in range(blocks):
        yield _learned(sums.where(F.col("b") == b).collect())


def identify(docs: DataFrame, examples: DataFrame, keys: dict[str, Column], text: str = "text", lang: str = "lang", dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """One row for each document: the ``keys`` columns, lang_pred and score.

    ``examples`` are the rows to learn from. lang_pred is the learned value with the largest cosine, ties
    to the smaller value by code point; ``und`` where the text is null or has no letter, or where nothing
    could be learned. score is (1 + cosine) / 2, 0 for ``und``. Repeated rows each get their row; long
    texts are read whole, in pieces; other columns of ``docs`` are not read. A key with the name of a result column
    goes by that name with ``_in`` behind it. Any number of languages can be learned.
    """
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession)
    row = F.struct(F.lit(0).alias("c"), *[c.alias(f"c{i}") for i, c in enumerate(keys.values())])
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("t"), F.lit(None).cast("string").alias("l"), F.lit(-2.0).alias("s"))
    types = [f.dataType.simpleString() for f in rows.schema["row"].dataType.fields[1:]]
    flat = ", ".join(["t string", "l string", "s double", *[f"c{i} {t}" for i, t in enumerate(types)]])
    rows = rows.select("t", "l", "s", "row.*").drop("c")
    for i, learned in enumerate(prototypes(examples, text, lang, dims, block)):
        names = [k for k, _ in learned]
        P = np.array([v for _, v in learned], dtype=np.float64).reshape(len(names), dims)

        def predict(batches: Iterator[pd.DataFrame], names=names, P=P) -> Iterator[pd.DataFrame]:
            encoder = Encoder(dims)
            for pdf in batches:
                for part in chunks(pdf, "t"):
                    vectors, has = encoder.encode(list(part["t"]))
                    # integers below 2^53 throughout: the product is exact in any order of summation
                    cos = units(vectors, GRID) @ P.T / GRID**2 if names else np.full((len(part), 1), -2.0)
                    best = cos.argmax(1)
                    top, out = cos[np.arange(len(best)), best], part.copy()
                    was, old = part["s"].to_numpy(), part["l"].tolist()
                    better = [h and bool(names) and (c > w or c == w and names[b] < o) for h, c, w, b, o in zip(has, top, was, best, old, strict=True)]
                    out["l"] = [names[b] if y else o for y, b, o in zip(better, best, old, strict=True)]
                    out["s"] = np.where(better, top, was)
                    yield out

        rows = (scratch.keep(rows) if i else rows).mapInPandas(predict, flat)
    score = F.when(F.col("l").isNull(), 0.0).otherwise(F.least(F.greatest((1 + F.col("s")) / 2, F.lit(0.0)), F.lit(1.0)))
    return rows.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(key_names(keys, ("lang_pred", "score")))], F.coalesce("l", F.lit("und")).alias("lang_pred"), score.alias("score"))
