"""States over time: openings, nested source sets, annual series, events, counterfactuals, validity masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def opening_timeline(stations: DataFrame) -> DataFrame:
    """Per year: how many opened, their names in order, and the running total. One row a year, so one window is fine."""
    years = stations.groupBy("opening_year").agg(F.count("*").alias("opened"), F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))
    return years.withColumn("cumulative", F.sum("opened").over(Window.orderBy("opening_year").rowsBetween(Window.unboundedPreceding, 0)))


def open_in(stations: DataFrame, years: DataFrame) -> DataFrame:
    """(year, station_id) of every station open in that year (opened in it or before)."""
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    wide = stations.crossJoin(F.broadcast(span)).where("opening_year <= hi")  # span is one row
    each = wide.withColumn("year", F.explode(F.sequence(F.greatest("opening_year", "lo"), F.col("hi"))))
    return each.join(F.broadcast(years.select("year").distinct()), "year", "left_semi").select("year", "station_id")


def source_states(opened: DataFrame) -> DataFrame:
    """Years that share one set of stations: state_id names the set's size, which must not repeat for other sets."""
    sets = opened.groupBy("year").agg(F.array_sort(F.collect_set("station_id")).alias("ids"))
    states = sets.groupBy("ids").agg(F.array_sort(F.collect_list("year")).alias("years"))
    digest = F.sha2(F.concat(F.array_join(F.col("ids").cast("array<string>"), "\n"), F.lit("\n")), 256)
    return states.select(F.concat(F.lit("state_"), F.size("ids")).alias("state_id"), F.size("ids").alias("stations"), "ids", "years", digest.alias("digest"))


def lost_between_years(opened: DataFrame) -> DataFrame:
    """(year, stations, lost) of years that lack stations of the year before; ``opened`` as of ``open_in``.

    Stations are compared one by one across years, by equality; no year's stations are gathered in one row.
    """
    counts = opened.groupBy("year").agg(F.count_distinct("station_id").cast("int").alias("stations"))
    before = counts.select("year", F.lag("year").over(Window.orderBy("year")).alias("before"))  # a row for each year
    was = opened.select(F.col("year").alias("before"), "station_id").distinct().join(F.broadcast(before.where("before IS NOT NULL")), "before")
    gone = was.join(opened.select("year", "station_id"), ["year", "station_id"], "left_anti")
    return gone.groupBy("year").agg(F.count("*").cast("int").alias("lost")).join(counts, "year").select("year", "stations", "lost")


def colliding_states(states: DataFrame) -> DataFrame:
    return states.groupBy("state_id").count().where("count > 1")


def not_nested(states: DataFrame) -> DataFrame:
    """States that lose a station of the state before: must be empty."""
    w = Window.orderBy(F.col("years")[0])
    return states.withColumn("before", F.lag("ids").over(w)).where(F.size(F.array_except("before", "ids")) > 0)


def change_from_base(series: DataFrame, keys: list[str], value: str, year: str = "year") -> DataFrame:
    """Difference from, and growth in percent over, the first year of each key."""
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(value).over(w)
    return series.withColumn("change", F.round(F.col(value) - base, 6)).withColumn("growth_pct", F.round(F.try_divide(100.0 * (F.col(value) - base), base), 6))


def events(series: DataFrame, state: str = "state_id", year: str = "year") -> DataFrame:
    """Years whose state is not that of the year before. One row a year."""
    w = Window.orderBy(year)
    return series.withColumn("previous_state", F.lag(state).over(w)).where(F.col("previous_state") != F.col(state))


def mask_transitions(grid: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Per year: cells valid, and cells that became valid or invalid since the year before (dense grid of cell, year, valid)."""
    w = Window.partitionBy(cell).orderBy("year")
    rows = grid.withColumn("before", F.lag("valid").over(w))
    up, down = F.col("valid") & ~F.col("before"), ~F.col("valid") & F.col("before")
    return rows.groupBy("year").agg(F.count_if("valid").alias("valid"), F.count_if(up).alias("up"), F.count_if(down).alias("down"))


def union_and_common_growth(grid: DataFrame, first: int, last: int, cell: str = "cell_id") -> DataFrame:
    """Growth in percent over cells valid in any year (a) and over cells valid in all years (b)."""
    per = grid.groupBy(cell).agg(F.bool_and("valid").alias("all"), *[F.sum(F.when(F.col("year") == y, F.col("value"))).alias(f"v{i}") for i, y in enumerate((first, last))])
    both = lambda c: F.sum(F.when(F.col("all"), F.col(c)))
    sums = per.agg(F.sum("v0").alias("a0"), F.sum("v1").alias("a1"), both("v0").alias("b0"), both("v1").alias("b1"), F.count_if("all").alias("common_cells"))
    g = lambda x, y: F.round(F.try_divide(100.0 * (F.col(y) - F.col(x)), F.col(x)), 6)
    return sums.select(g("a0", "a1").alias("growth_a"), g("b0", "b1").alias("growth_b"), "common_cells")


def mask_switches(grid: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Cells by how often they change between valid and invalid: switches, cells."""
    w = Window.partitionBy(cell).orderBy("year")
    per = grid.withColumn("sw", F.col("valid") != F.lag("valid").over(w)).groupBy(cell).agg(F.count_if("sw").alias("switches"))
    return per.groupBy("switches").agg(F.count("*").alias("cells"))


def widest_gap(series: DataFrame, a: str, b: str, year: str = "year") -> DataFrame:
    """The year in which two series differ most, the earliest of equals."""
    return series.agg(F.min_by(F.struct(year, (F.col(b) - F.col(a)).alias("gap")), F.struct(-F.abs(F.col(b) - F.col(a)), F.col(year))).alias("m")).select("m.*")
