"""Totals, rankings, records and labels of small result tables, and consensus over members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netaccess.operators.quantiles import exact_quantiles


def strict_pct(part: Column, whole: Column) -> Column:
    """Percent of a whole that must be positive: raises otherwise."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.raise_error(F.lit("percentage of a whole that is not positive")).cast("double"))


def prefixed(df: DataFrame, code: str, prefix: str, longer_than: int) -> DataFrame:
    """Rows whose code starts with a prefix and is longer than so many characters."""
    return df.where(F.col(code).startswith(prefix) & (F.length(code) > longer_than))


def official_totals(df: DataFrame, code: str, period: str, city: str, tolerance: float = 0.05) -> DataFrame:
    """(code, people) of districts from a column in thousands, rounded to people.

    Raises unless every code has one row and the districts add up to the row of ``city`` within ``tolerance`` thousand.
    """
    again = df.groupBy(code).count().where("count > 1").limit(3).collect()
    if again:
        raise ValueError(f"codes with several rows: {[r[0] for r in again]}")
    own = F.col(code) == city
    sums = df.agg(F.sum(F.when(~own, F.col(period))).alias("d"), F.sum(F.when(own, F.col(period))).alias("c")).first()
    if sums["c"] is None or abs((sums["d"] or 0.0) - sums["c"]) > tolerance:
        raise ValueError(f"districts have {sums['d']} thousand, {city} {sums['c']}")
    return df.where(~own).select(F.col(code).alias("code"), F.round(F.col(period) * 1000).cast("long").alias("people"))


def scaled_to(df: DataFrame, published: DataFrame, keys: list[str], value: str, total: str) -> DataFrame:
    """Values times (published total over the sum of the group's values), null and NaN values kept null."""
    v = F.when(~F.isnan(value), F.col(value))
    sums = df.groupBy(*keys).agg(F.sum(v).alias("_sum")).where("_sum > 0").join(published.select(*keys, total), keys)
    return df.join(sums.select(*keys, (F.col(total) / F.col("_sum")).alias("_f")), keys).withColumn("scaled", v * F.col("_f")).drop("_f")


def exactly_one(df: DataFrame, where: Column) -> DataFrame:
    """The one row that a scope selects: raises if there is none or several."""
    out = df.where(where)
    n = out.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no row' if n == 0 else 'several rows'} in the scope")
    return out


def placements(snaps: DataFrame, by: str, end_m: float = 1.0) -> DataFrame:
    """Of snapped points (edge_id, cost_to_u, cost_to_v): interior and endpoint ones, distinct edges, most on one edge."""
    near = F.least("cost_to_u", "cost_to_v") <= end_m
    per = snaps.groupBy(by, "edge_id").agg(F.count("*").alias("m"), F.count_if(near).alias("e"))
    return per.groupBy(by).agg(F.sum("m").alias("points"), F.sum("e").alias("endpoint"), (F.sum("m") - F.sum("e")).alias("interior"), F.count("*").alias("edges"), F.max("m").alias("most"))


def top_counts(df: DataFrame, column: str, k: int = 6) -> DataFrame:
    """The k most frequent values that are not null, ties to the smaller one."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank by value, largest first, then by name: for tables of one row a district."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), name)))


def leader(df: DataFrame, value: str, name: str, words: str) -> DataFrame:
    """One sentence on the first by rank: ``words`` with {name} and {value}."""
    best = df.agg(F.min_by(F.struct(name, value), F.struct(-F.col(value), F.col(name))).alias("b"))
    before, rest = words.split("{name}")
    between, after = rest.split("{value}")
    return best.select(F.concat(F.lit(before), F.col(f"b.{name}"), F.lit(between), F.format_string("%.1f", F.col(f"b.{value}").cast("double")), F.lit(after)).alias("sentence"))


def search(places: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Places (kind, label, alias) whose label or alias holds the words, whatever their case; by kind, then label."""
    q = query.strip().lower()
    hit = F.lower("label").contains(q) | F.coalesce(F.lower("alias").contains(q), F.lit(False))
    return places.where(hit & F.lit(bool(q))).orderBy("kind", "label", "alias").limit(limit)


def colour_cap(df: DataFrame, value: str, share: float = 0.98) -> DataFrame:
    """The linear-interpolated quantile that a colour scale ends at; 1 for an empty table."""
    found = exact_quantiles(df, value, [share], []).select(F.col("q")[0].alias("cap"))
    return found.groupBy().agg(F.coalesce(F.max("cap"), F.lit(1.0)).alias("cap"))


def year_gaps(df: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """(keys, year, before) where the year before in the series isn't the year less one."""
    w = Window.partitionBy(*keys).orderBy(year)
    return df.select(*keys, year).distinct().withColumn("before", F.lag(year).over(w)).where(F.col(year) - F.col("before") != 1)


def latest(df: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """The row of the last year of each key; raises where a series has gaps or repeats a year."""
    if df.groupBy(*keys, year).count().where("count > 1").limit(1).count() or year_gaps(df, keys, year).limit(1).count():
        raise ValueError("a series has gaps or repeats a year")
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), year).alias("r")).select(*keys, "r.*")


def zero_share_note(pct: Column, nearest: Column, margin: Column, budget: float, tight: float) -> Column:
    """What to say of a share of 0: how far the nearest cell is, and whether that is close to the threshold; null above 0."""
    base = F.concat(F.lit(f"No cell lies within {budget:.0f} m. The nearest is "), F.format_string("%.1f", nearest), F.lit(" m away, "), F.format_string("%.0f", margin))
    return F.when(pct > 0, F.lit(None).cast("string")).when(margin <= tight, F.concat(base, F.lit(" m outside the threshold: sensitive to mapping and walking assumptions."))).otherwise(F.concat(base, F.lit(" m beyond the threshold.")))


def points_text(c: Column) -> Column:
    """Signed percentage points with a true minus; what rounds to zero has no sign."""
    r = F.round(c, 2)
    return F.when(r == 0, F.lit("0.00 pp")).otherwise(F.concat(F.when(r > 0, "+").otherwise("−"), F.format_string("%,.2f", F.abs(r)), F.lit(" pp")))


def rounded_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """All float columns rounded half to even."""
    return df.select([F.bround(f"`{c}`", digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def agreed_lines(members: DataFrame) -> DataFrame:
    """Lines from relations' members (ref, name, colour, member, length): one row for each ref.

    A member counts once, by its smallest length; the colour is kept only where the line has exactly one, the label is the first
    name. Columns: ref, label, colour, colours, members, length.
    """
    own = members.groupBy("ref", "member").agg(F.min("length").alias("length"))
    size = own.groupBy("ref").agg(F.count("*").alias("members"), F.sum("length").alias("length"))
    n = F.count_distinct("colour")
    facts = members.groupBy("ref").agg(F.min("name").alias("label"), n.alias("colours"), F.when(n == 1, F.min("colour")).alias("colour"))
    return facts.join(size, "ref").select("ref", "label", "colour", "colours", "members", "length")


def bridge(current: DataFrame, standardised: DataFrame, value: str) -> DataFrame:
    """Two one-row results side by side and their difference."""
    a, b = current.select(F.col(value).alias("current")), standardised.select(F.col(value).alias("standardised"))
    return a.crossJoin(F.broadcast(b)).withColumn("difference", F.round(F.col("current") - F.col("standardised"), 6))


def spread(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two columns over districts, and the largest over the smallest ratio."""
    ratio = F.try_divide(F.col(b), F.col(a))
    return df.agg(F.round(F.corr(a, b), 6).alias("r"), F.round(F.max(ratio), 6).alias("max_ratio"), F.round(F.min(ratio), 6).alias("min_ratio"), F.round(F.max(ratio) / F.min(ratio), 6).alias("ratio_spread"))
