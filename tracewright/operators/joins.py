"""Joins that the engines' built-in ones don't spell out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import BROADCAST_ROWS, fits


def sized(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcast if it was measured to be small, else as it is."""
    return F.broadcast(frame) if fits(frame, rows) else frame


def with_default(left: DataFrame, right: DataFrame, on: str, columns: dict[str, Column]) -> DataFrame:
    """Left join; each of ``columns`` of the right side falls back to its default where there is no match. Keys of ``right`` are unique."""
    joined = left.join(right.select(on, *columns), on, "left")
    return joined.select(*left.columns, *(F.coalesce(F.col(c), d).alias(c) for c, d in columns.items()))


def flagged(left: DataFrame, key: Column, members: DataFrame, member: Column, name: str, yes="Matching", no="Not Matching", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` with a column that says whether ``key`` is among ``members``. Null keys are not; repeated members change nothing."""
    asked = members.select(member.alias("_member")).filter(F.col("_member").isNotNull()).distinct().withColumn("_in", F.lit(1))
    joined = left.withColumn("_member", key).join(sized(asked, rows), "_member", "left")
    return joined.withColumn(name, F.when(F.col("_in").isNotNull(), F.lit(yes)).otherwise(F.lit(no))).drop("_member", "_in")


def excluded(left: DataFrame, rules: DataFrame, kinds: list[list[str]]) -> DataFrame:
    """The rows that no rule names. A rule is a row of ``rules``; for each list of columns in ``kinds`` the rules whose other columns are null apply.

    ``rules`` is a small table kept by people; it is counted before it is broadcast.
    """
    every = sorted({c for kind in kinds for c in kind})
    for kind in kinds:
        only = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in kind else F.col(c).isNull() for c in every])
        left = left.join(sized(rules.filter(only).select(*kind).distinct()), kind, "left_anti")
    return left


def first_match(files: DataFrame, path: str, patterns: DataFrame, prefix: str, rank: str, row: str, depths: tuple[int, ...]) -> DataFrame:
    """``files`` with the columns of the pattern of lowest ``rank`` whose ``prefix`` (a folder ending in '/') starts ``path``.

    A prefix is compared with the same number of leading folders of the path, so each depth is an equi join and there is no product of files
    and patterns. ``depths`` are the numbers of slashes that prefixes have; files without a match keep nulls.
    """
    def head(n: int) -> Column:
        cut = F.substring_index(F.col(path), "/", n)
        return F.when(F.length(cut) < F.length(path), F.concat(cut, F.lit("/")))

    heads = F.array(*(head(n) for n in depths))
    keys = files.select(row, F.explode(F.array_distinct(F.filter(heads, lambda h: h.isNotNull()))).alias(prefix))
    others = [c for c in patterns.columns if c != prefix]
    best = keys.join(sized(patterns), prefix).groupBy(row).agg(F.min_by(F.struct(prefix, *others), F.col(rank)).alias("_best"))
    return files.join(best, row, "left").select(*files.columns, *(F.col(f"_best.{c}").alias(f"matched_{c}") for c in [prefix, *others]))


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], by: list[str], hot: int | None = None) -> DataFrame:
    """Row n of each group of ``left`` beside row n of the same group of ``right``; orders must be total. Longer sides lose their rest.

    Rows are joined on group and number, so a hot group spreads over all tasks; it is numbered by ranges (see ``windows.positions``).
    """
    from tracewright.operators.windows import positions

    a, b = positions(left, by, left_order, "_n", hot), positions(right, by, right_order, "_n", hot)
    return a.join(b, [*by, "_n"]).drop("_n")


def both_sides(left: DataFrame, right: DataFrame, on: str, side: str = "side") -> DataFrame:
    """Full outer join with a column that tells where a row comes from: both, left or right. Null keys match nothing."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    where = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right")
    return a.join(b, on, "full").withColumn(side, where).drop("_l", "_r")


def upserted(base: DataFrame, changes: DataFrame, key: str, flag: str = "is_updated") -> DataFrame:
    """``base`` after ``changes`` of the same columns: a key that is new comes in, one that is there once is replaced, and of one that is there
    several times only ``flag`` is set. Of several changes of a key the first in the order of all columns counts."""
    columns = [c for c in base.columns if c != key]
    change = changes.groupBy(key).agg(F.min(F.struct(*columns)).alias("_new"))
    counted = base.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    joined = counted.join(change, key, "full")
    new = F.col("_n").isNull()
    replaced = F.col("_new").isNotNull() & (F.col("_n") == 1)
    return joined.select(key, *(F.when(new | replaced, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns), F.when(F.col("_new").isNotNull() & ~new, 1).otherwise(0).alias(flag))


def first_by_role(frame: DataFrame, key: str, role: str, value: str, order: Column, roles: dict) -> DataFrame:
    """One row a key: for each role the value that comes first in ``order``; null without one. (A scalar subquery that takes the first row.)"""
    return frame.groupBy(key).agg(*(F.min_by(F.when(F.col(role) == r, F.col(value)), F.when(F.col(role) == r, order)).alias(name) for r, name in roles.items()))
