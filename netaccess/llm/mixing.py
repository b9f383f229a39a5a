"""Mixing sources to target weights by capped water-filling.

Each source's target is its weighted share of the whole, clamped at ``cap`` times its size; what the
clamp takes away is dealt again by weight until no source is above its clamp. A source is then taken as
whole repetitions of all its documents plus a fractional repetition: documents in a seeded random order
(MD5 of seed, id and text) are repeated once more until the target's words are reached; the document at the
border is repeated up to the word that reaches it, so each source meets its target to the word.

The order within a source is never sorted as a whole: ids fall into ``BUCKETS`` ranges of the hash, the
ranges' sizes are summed (partial sums before the shuffle), and only documents in the one range that
holds the border are ordered, about 1/BUCKETS of a source however hot it is. Rows that repeat one id and
text share a place; they are dealt into pieces of ``PIECE`` rows, pieces are ordered by their sums, and rows
only within a piece, so a third of all rows being one row is no large task. Only border rows are shuffled.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netaccess.llm.common import Scratch, n_words

#: Hash ranges of a source, named by the first HEX digits of the hash.
HEX = 3
BUCKETS = 16**HEX
#: Rows of a piece, as a power of two.
PIECE = 12
#: A plan of at most so many sources is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def water_fill(sizes: list[int], weights: list[float], cap: float = 3.0, total: int | None = None) -> list[float]:
    """Targets that sum to ``total`` (the sum of sizes unless given), or to all caps if these are less."""
    rest = Fraction(sum(sizes) if total is None else total)
    targets = [Fraction(0)] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while open_ and rest > 0:
        weight = sum(Fraction(weights[i]) for i in open_)
        full = [i for i in open_ if rest * Fraction(weights[i]) >= Fraction(cap) * sizes[i] * weight]
        if not full:
            for i in open_:
                targets[i] = rest * Fraction(weights[i]) / weight
            break
        for i in full:
            targets[i] = Fraction(cap) * sizes[i]
        rest -= sum(targets[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return [float(t) for t in targets]


def _planned(docs: DataFrame, row: Column, text: str, source: str, doc_id: str, cycle, cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """``row`` (a struct of what to keep) and mix: size, source_size, target, taken. No column of ``docs`` can clash with these.

    First the documents that are taken a whole number of times, then those of the ranges that hold the borders.
    """
    scratch = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    t, size = F.col(f"`{text}`"), n_words(F.col(f"`{text}`"))
    blank = F.lit("")
    # the text is in the order too, so that documents without an id, or of one id, do not share a place
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), blank), F.lit(":"), F.md5(F.coalesce(t, blank))))
    rows = docs.select(row.alias("row"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), order.alias("o"), F.substring(order, 1, HEX).alias("bucket"))
    sums = scratch.keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")))
    # one row for each source: names and sizes are what the plan is made of
    sources = [(r["source"], r["s"]) for r in sums.groupBy("source").agg(F.sum("s").alias("s")).collect()]
    sources.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([s for _, s in sources], [cycle[i % len(cycle)] for i in range(len(sources))], cap)
    plan = []
    for (name, s), target in zip(sources, targets, strict=True):
        whole = int(Fraction(target) // s) if s else 0
        plan.append((name, s, target, whole, int(target) - whole * s))
    planned = spark.createDataFrame(plan, "p_source string, source_size long, target double, whole long, extra long")
    # the range in which each source's extra words end, and how many words remain there
    running = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
    border = (
        sums.withColumn("after", running)
        .join(planned, F.col("source").eqNullSafe(F.col("p_source")))
        .where((F.col("after") > F.col("extra")) & (F.col("after") - F.col("s") <= F.col("extra")))
        .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.col("extra") - F.col("after") + F.col("s")).alias("b_left"))
    )
    full = planned.join(border, F.col("p_source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    # a source whose extra words no range ends takes none or all of them
    full = full.select("p_source", "source_size", "target", "whole", F.coalesce("b_bucket", F.lit("~")).alias("b_bucket"), F.coalesce("b_left", F.lit(0).cast("long")).alias("b_left"))
    full = F.broadcast(full) if len(plan) <= BROADCAST_SOURCES else full
    joined = rows.join(full, F.col("source").eqNullSafe(F.col("p_source")))
    clear = joined.where("bucket <> b_bucket").withColumn("x", F.when(F.col("bucket") < F.col("b_bucket"), F.col("size")).otherwise(F.lit(0).cast("long")))
    edge = _border(scratch, joined.where("bucket = b_bucket"))
    taken = (F.col("whole") * F.col("size") + F.col("x")).alias("taken")
    return tuple(df.select("row", F.struct("size", "source_size", "target", taken).alias("mix")) for df in (clear, edge))


def _border(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows of the ranges that hold the borders, with x: the words that the fractional repetition takes of each."""
    # written once: the pieces of equal rows must not change between the plans that read them
    same = F.xxhash64(F.to_json(F.struct("row")))
    rows = scratch.keep(rows.withColumn("same", same).withColumn("u", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("u", PIECE)))
    key = ["source", "o", "same", "piece"]
    pieces = rows.groupBy(*key).agg(F.sum("size").alias("s"))
    running = F.sum("s").over(Window.partitionBy("source").orderBy("o", "same", "piece")) - F.col("s")
    pieces = pieces.select(*[F.col(c).alias(f"k_{c}") for c in key], running.alias("k_before"))
    matches = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key])
    within = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("b_left") - F.col("k_before") - F.col("within")
    found = rows.withColumn("within", within).join(pieces, matches)
    return found.withColumn("x", F.least(F.greatest(left, F.lit(0)), F.col("size")))


RESULTS = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id", cycle=(5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """``keep`` columns of every document plus size, source_size, target and taken (words).

    Sources in code point order, null last, get the weights of ``cycle`` in turn and share the sum of all
    sizes. A null text has size 0, as has one without words; sources without words get target 0. Repeated
    rows are documents of their own. taken = whole repetitions * size, plus the size once more for
    documents before the border, plus a part for the document at the border; never above cap * size.
    An empty table gives no rows. A null doc_id counts as an empty one in the order. A kept column that has
    the name of a result column goes by that name with ``_in`` behind it.
    """
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    clear, edge = _planned(docs, row, text, source, doc_id, cycle, cap, seed)
    out = clear.unionByName(edge)
    named = lambda c: f"{c}_in" if c.lower() in RESULTS else c
    return out.select(*[F.col(f"row.c{i}").alias(named(c)) for i, c in enumerate(keep)], *[F.col(f"mix.{c}") for c in RESULTS])


def words_upto(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word, by bisection over prefixes: no array of words is made.

    The smallest prefix with n + 1 words ends in the first character of the next word; what it has before
    that, without white space at its end, is the result. The whole text where it has no more than n words.
    """
    bits = 31
    start = F.struct(F.lit(0).alias("lo"), (F.length(text) + 1).alias("hi"))  # lo has at most n words, hi more (or is beyond the end)

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        more = n_words(F.substring(text, F.lit(1), mid)) > n
        done = at["hi"] - at["lo"] <= 1
        return F.struct(F.when(done | more, at["lo"]).otherwise(mid).alias("lo"), F.when(~done & more, mid).otherwise(at["hi"]).alias("hi"))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, halve, lambda at: at["lo"])
    whole = n_words(text) <= n
    return F.when(n <= 0, F.lit("")).when(whole, text).otherwise(F.rtrim(F.substring(text, F.lit(1), cut), F.lit(" \t\n\x0b\x0c\r")))


def sample(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cycle=(5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: every document repeated as often as it is taken.

    A fractional repetition is a row whose text ends with the word that meets the source's target.
    Documents without words are part of every mix, once.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    clear, edge = _planned(docs, row, text, source, doc_id, cycle, cap, seed)
    size, taken = F.col("mix.size"), F.col("mix.taken")
    whole = F.when(size > 0, F.floor(taken / F.when(size > 0, size))).otherwise(F.lit(1)).cast("int")
    part = F.when(size > 0, taken - whole * size).otherwise(F.lit(0).cast("long"))
    t = docs.columns.index(text)
    entire = clear.unionByName(edge).select("row", F.explode(F.array_repeat(F.lit(0), whole)).alias("copy")).select("row")
    # at most one document of each source is at its border
    ends = edge.where(part > 0).select("row", part.alias("n"))
    cut = [words_upto(F.col(f"row.c{i}"), F.col("n")).alias(f"c{i}") if i == t else F.col(f"row.c{i}") for i in range(len(docs.columns))]
    out = entire.unionByName(ends.select(F.struct(*cut).alias("row")))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
