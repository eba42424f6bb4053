"""Counts by parts of times, dense grids, shares and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.detectors import UNKNOWN, semantic_type


def count_by_prefix(frame: DataFrame, text: Column, length: int, name: str = "period") -> DataFrame:
    """(name, cnt): rows by the first ``length`` characters of a time text; shorter and null texts are left out."""
    return frame.select(F.substring(text, 1, length).alias(name)).filter(F.length(name) == length).groupBy(name).agg(F.count(F.lit(1)).alias("cnt"))


def dense_months(counts: DataFrame) -> DataFrame:
    """(year, month, cnt): twelve rows for each year of ``counts`` (period ``yyyy-MM``), missing months with 0."""
    years = counts.select(F.substring("period", 1, 4).alias("year")).distinct()
    grid = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    grid = grid.withColumn("period", F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0")))
    return grid.join(counts, "period", "left").select("year", F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def dense_minutes(counts: DataFrame) -> DataFrame:
    """(day, minute, cnt): 1440 rows for each day of ``counts`` (period ``yyyy-MM-dd HH:mm``), 00:00 to 23:59."""
    days = counts.select(F.substring("period", 1, 10).alias("day")).distinct()
    grid = days.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1439))))
    clock = F.concat_ws(":", F.lpad(F.floor(F.col("m") / 60).cast("string"), 2, "0"), F.lpad(F.pmod(F.col("m"), F.lit(60)).cast("string"), 2, "0"))
    grid = grid.select("day", clock.alias("minute")).withColumn("period", F.concat_ws(" ", "day", "minute"))
    return grid.join(counts, "period", "left").select("day", "minute", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def heat_states(frame: DataFrame, time: Column, on: Column, off: Column) -> DataFrame:
    """(month, hour, day, state): 4 where both kinds occurred, 3 off, 2 on, 1 any other activity."""
    per = frame.select(F.date_format(time, "yyyy-MM").alias("month"), F.date_format(time, "HH").alias("hour"), F.dayofmonth(time).alias("day"), on.cast("int").alias("on"), off.cast("int").alias("off"))
    per = per.filter("month is not null").groupBy("month", "hour", "day").agg(F.max("on").alias("on"), F.max("off").alias("off"))
    state = F.when((F.col("on") == 1) & (F.col("off") == 1), 4).when(F.col("off") == 1, 3).when(F.col("on") == 1, 2).otherwise(1)
    return per.select("month", "hour", "day", state.alias("state"))


def heat_map(states: DataFrame) -> DataFrame:
    """24 rows a month with 31 columns; 0 where nothing happened."""
    wide = states.groupBy("month", "hour").pivot("day", list(range(1, 32))).agg(F.max("state"))
    hours = states.select("month").distinct().withColumn("hour", F.explode(F.array(*(F.lit(f"{h:02d}") for h in range(24)))))
    joined = hours.join(wide, ["month", "hour"], "left")
    return joined.select("month", "hour", *(F.coalesce(F.col(str(d)), F.lit(0)).alias(f"day{d}") for d in range(1, 32)))


def shares(frame: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """(by, cnt, share) of all rows; the total is the sum of the groups, so no window over rows is needed."""
    groups = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))
    total = groups.agg(F.sum("cnt").alias("_all"))
    return groups.withColumn("share", F.round(F.col("cnt") / total.scalar(), digits))


def sums_where(frame: DataFrame, value: Column, conditions: dict[str, Column]) -> DataFrame:
    """One row: the sum of ``value`` under each condition, in all, and what no condition covers."""
    parts = [F.coalesce(F.sum(F.when(c, value)), F.lit(0)).alias(n) for n, c in conditions.items()]
    one = frame.agg(*parts, F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    rest = F.col("total")
    for n in conditions:
        rest = rest - F.col(n)
    return one.withColumn("rest", rest)


def joined_text(frame: DataFrame, by: list[str], value: str, order: str, mark: str = "|") -> DataFrame:
    """(by, joined): the distinct non-null values of each group in the order of ``order``."""
    pairs = frame.filter(F.col(value).isNotNull()).select(*by, value, order).distinct()
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return pairs.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["v"].cast("string")), mark).alias("joined"))


def long_form(frame: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, value): the columns of a table one below the other."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return frame.select(F.explode(pairs).alias("p")).select(F.lit(table).alias("table"), "p.column", "p.value")


def top_values(values: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` greatest distinct values of each column, by partial top-n: a column of a hot table isn't sorted as a whole in one task."""
    distinct = values.filter(F.col("value").isNotNull()).distinct()
    within = Window.partitionBy("table", "column", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("value"))
    few = distinct.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= n)
    final = Window.partitionBy("table", "column").orderBy(F.desc("value"))
    return few.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n).drop("_r")


def profile(values: DataFrame, n: int = 50) -> DataFrame:
    """(table, column, type, format, cnt): the semantic types among the ``n`` greatest values of each column. (The bound is the report's own.)"""
    typed = top_values(values, n).select("table", "column", semantic_type(F.col("value"), F.col("column")).alias("t"))
    per = typed.groupBy("table", "column", "t.type", "t.format").agg(F.count(F.lit(1)).alias("cnt"))
    return per.filter(F.col("type") != UNKNOWN)


def grouped_twice(frame: DataFrame, outer: str, inner: str, columns: list[str]) -> DataFrame:
    """(outer, groups): for each ``outer`` the array of its ``inner`` groups in order, each with the sorted array of its ``records``.

    For nested output only: a group that no row can hold should stay flat.
    """
    per = frame.groupBy(outer, inner).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("records"))
    return per.groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(inner, "records"))).alias("groups"))
