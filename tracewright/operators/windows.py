"""Operators over ordered rows. A log is ordered within its volume, so every operator works within groups (``by``).

A group may hold a third of all rows. Groups of up to ``HOT_ROWS`` rows are ordered in one window. If any is larger, rows get their exact position
first: quantiles of the leading order column cut hot groups into ranges, ranges are numbered on their own, and the counts of the ranges before are
added. Blocks of ``HOT_ROWS`` positions, each with the few last rows of the block before (the halo), then give what one window would give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut, lookup

#: A group with more rows than this isn't ordered in one task.
HOT_ROWS = 1_000_000
#: A hot group is cut into at most this many ranges.
RANGES = 1000


#: An input that the optimiser knows to have at most so many bytes has no group that is too large for one task.
SMALL_BYTES = 64 << 20


def has_hot_groups(frame: DataFrame, by: list[str], hot: int) -> bool:
    if hot >= HOT_ROWS and int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return False
    return not frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).isEmpty()


def positions(frame: DataFrame, by: list[str], order: list[Column], name: str = "_pos", hot: int | None = None) -> DataFrame:
    """``frame`` with ``name``: 0, 1, 2 ... in each group by ``order``, which is to be total and begin with a number or time.

    Null groups are groups like others. Rows whose order is equal are numbered in any order.
    """
    hot = hot or HOT_ROWS
    if not has_hot_groups(frame, by, hot):
        return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint") - 1)
    keys = [f"_by{i}" for i in range(len(by))]
    keyed = frame.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for k, c in zip(keys, by, strict=True)}).withColumn("_at", order[0].cast("double")).withColumn("_id", F.xxhash64(F.monotonically_increasing_id()))
    keyed = cut(keyed)
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    marks = lookup(keyed, sizes, keys, "_id", "inner").groupBy(*keys).agg(F.percentile_approx("_at", [k / RANGES for k in range(1, RANGES)]).alias("_marks"))
    ranged = lookup(keyed, marks, keys, "_id").withColumn("_range", F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col("_at"))), F.lit(0))).drop("_marks")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(*keys, "_range", (F.sum("n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return lookup(ranged, before, [*keys, "_range"], "_id").withColumn(name, F.col("_before") + own - 1).drop(*keys, "_range", "_before", "_at", "_id")


def blocked(frame: DataFrame, by: list[str], order: list[Column], halo: int, hot: int | None = None) -> tuple[DataFrame, Window]:
    """(rows, window): ``rows`` are those of ``frame`` and, marked ``_halo``, the ``halo`` rows before each block; in ``window`` every row that isn't
    marked sees the same ``halo`` rows before it as in its whole group."""
    hot = hot or HOT_ROWS
    if not has_hot_groups(frame, by, hot):
        return frame.withColumn("_halo", F.lit(False)), Window.partitionBy(*by).orderBy(*order)
    size = max(hot, halo)
    numbered = positions(frame, by, order, "_pos", hot)
    block = F.floor(F.col("_pos") / size)
    rows = numbered.withColumn("_block", F.explode(F.when(F.pmod("_pos", F.lit(size)) >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))))
    return rows.withColumn("_halo", F.col("_block") > block), Window.partitionBy(*by, "_block").orderBy("_pos")


def _without_halo(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("_halo")).drop("_halo", "_pos", "_block")


def chained(frame: DataFrame, by: list[str], order: list[Column], link: str, own: str, carry: list[str], hot: int | None = None) -> DataFrame:
    """``frame`` with the columns ``carry`` of the row before (``prev_...``) and ``is_chained``: whether ``link`` names that row's ``own``."""
    rows, w = blocked(frame, by, order, 1, hot)
    before = _without_halo(rows.withColumn("_prev", F.lag(F.struct(own, *carry)).over(w)))
    linked = F.coalesce(F.col(link) == F.col(f"_prev.{own}"), F.lit(False))
    return before.select("*", *(F.col(f"_prev.{c}").alias(f"prev_{c}") for c in carry), linked.alias("is_chained")).drop("_prev")


# Pairs of log operations and what they did.
FILE_ACTIONS = {
    ("DeallocateFileRecordSegment", "InitializeFileRecordSegment"): "File Created",
    ("InitializeFileRecordSegment", "DeallocateFileRecordSegment"): "File Deleted",
    ("AddIndexEntryAllocation", "DeleteIndexEntryAllocation"): "Index Entry Added",
    ("DeleteIndexEntryAllocation", "AddIndexEntryAllocation"): "Index Entry Deleted",
    ("AddIndexEntryRoot", "DeleteIndexEntryRoot"): "Root Entry Added",
    ("DeleteIndexEntryRoot", "AddIndexEntryRoot"): "Root Entry Deleted",
}


def operation_pairs(redo: Column, undo: Column) -> Column:
    """What a pair of operations did, else null."""
    out = F.lit(None).cast("string")
    for (r, u), name in FILE_ACTIONS.items():
        out = F.when((redo == r) & (undo == u), name).otherwise(out)
    return out


def looked_back(frame: DataFrame, by: list[str], order: list[Column], distance: int, same: str, condition: Column, take: str, name: str, found: int = 1, hot: int | None = None) -> DataFrame:
    """``frame`` with ``name``: ``take`` of the nearest ``found`` rows among the ``distance`` before that have the same ``same`` and for which ``condition`` holds.

    The frame counts all rows of the log, so it isn't partitioned by ``same``. With ``found`` of 1 the value itself, else an array, nearest first.
    Rows without a match get null (an empty array).
    """
    rows, w = blocked(frame, by, order, distance, hot)
    seen = F.collect_list(F.when(condition, F.struct(F.col(same).alias("k"), F.col(take).alias("v")))).over(w.rowsBetween(-distance, -1))
    framed = _without_halo(rows.withColumn("_seen", seen))
    hits = F.transform(F.filter("_seen", lambda x: x["k"] == F.col(same)), lambda x: x["v"])
    near = F.slice(F.reverse(hits), 1, found)
    return framed.withColumn(name, F.try_element_at(near, F.lit(1)) if found == 1 else near).drop("_seen")


def longest(names: Column) -> Column:
    """The longest of an array's texts, the first of equals; null of an empty array. (Of two names of a file the longer is the full one.)"""
    return F.aggregate(names, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def first_rows(frame: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``frame`` with ``is_first`` for the first row of each group in ascending order.

    The least order of each group is found by partial aggregation and looked up, so no group is sorted; rows of equal order are first together.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    keyed = frame.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for k, c in zip(keys, by, strict=True)})
    least = keyed.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least"))
    return lookup(keyed, least, keys, order[-1]).withColumn("is_first", F.struct(*order).eqNullSafe(F.col("_least"))).drop(*keys, "_least")


def top_per_group(frame: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``; Spark keeps n rows a group before the shuffle."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def merged_lines(frame: DataFrame, by: list[str], order: str, text: str, starts: Column, hot: int | None = None) -> DataFrame:
    """(by, order, text): lines that don't start an entry are appended to the entry before, with a blank; those before the first start are one.

    In hot groups the starts of the blocks before are counted first. The lines of one entry become one value, so they meet in one task.
    """
    rows, w = blocked(frame, by, [F.col(order)], 0, hot)
    hot_block = "_block" in rows.columns
    marked = rows.withColumn("_entry", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if hot_block:
        per = rows.groupBy(*by, "_block").agg(F.sum(F.when(starts, 1).otherwise(0)).alias("n"))
        before = per.select(*by, "_block", (F.sum("n").over(Window.partitionBy(*by).orderBy("_block")) - F.col("n")).alias("_before"))
        same = reduce(lambda a, b: a & b, [marked[c].eqNullSafe(before[c]) for c in [*by, "_block"]])
        marked = marked.join(before, same).select(*(marked[c] for c in marked.columns if c != "_entry"), (marked["_entry"] + before["_before"]).alias("_entry"))
    marked = _without_halo(marked)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = marked.groupBy(*by, "_entry").agg(F.min(order).alias(order), F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias(text))
    return grouped.drop("_entry")


def spans(frame: DataFrame, by: list[str], time: str) -> DataFrame:
    """(by, first, last, seconds): whole seconds between the first and last time of each group."""
    per = frame.groupBy(*by).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return per.withColumn("seconds", F.timestamp_diff("SECOND", F.col("first"), F.col("last")))


def run_cells(hexed: Column) -> Column:
    """(length, offset) of the first run in a hex text: the header's low digit counts the length's bytes, the high one the offset's, both little endian."""
    from tracewright.functions.texts import little_endian

    a, b = (F.conv(F.substring(hexed, i, 1), 16, 10).try_cast("int") for i in (2, 1))
    length = F.substring(hexed, F.lit(3), a * 2)
    offset = F.substring(hexed, 3 + a * 2, b * 2)
    return F.struct(little_endian(length).alias("length"), little_endian(offset).alias("offset"))


def data_runs(hexed: Column) -> Column:
    """All runs of a hex text as an array of (length, lcn).

    A run's header gives the bytes of length (low digit) and offset (high digit), both little endian; the offset is signed and counts from the run
    before. A zero header or the end of the text ends the list; a run without an offset is sparse and has a null lcn. Null gives null.
    """
    from tracewright.functions.texts import little_endian

    digit = lambda at: F.coalesce(F.conv(F.substring(hexed, at, F.lit(1)), 16, 10).try_cast("int"), F.lit(0))
    kind = "struct<at:int,lcn:bigint,runs:array<struct<length:bigint,lcn:bigint>>>"
    start = F.struct(F.lit(1).alias("at"), F.lit(0).cast("bigint").alias("lcn"), F.array().cast("array<struct<length:bigint,lcn:bigint>>").alias("runs")).cast(kind)

    def once(value: Column, use) -> Column:
        """``use`` of a value that is worked out once, however often it is mentioned."""
        return F.transform(F.array(value), use)[0]

    def step(state: Column, _: Column) -> Column:
        over = F.struct((F.length(hexed) + 1).cast("int").alias("at"), state["lcn"].alias("lcn"), state["runs"].alias("runs")).cast(kind)

        def body(head: Column) -> Column:
            parts = F.struct(
                little_endian(F.substring(hexed, state["at"] + 2, head["n"] * 2)).alias("length"), little_endian(F.substring(hexed, state["at"] + 2 + head["n"] * 2, head["m"] * 2)).alias("raw"),
                F.pow(F.lit(2.0), (head["m"] * 8).cast("double")).cast("bigint").alias("top"),
            )
            offset = lambda x: F.when(head["m"] > 0, state["lcn"] + F.when(x["raw"] >= F.floor(x["top"] / 2), x["raw"] - x["top"]).otherwise(x["raw"]))
            runs = once(parts, lambda x: F.struct(x["length"].alias("length"), offset(x).alias("lcn")))
            return once(runs, lambda run: F.struct((state["at"] + 2 + (head["n"] + head["m"]) * 2).cast("int").alias("at"), F.coalesce(run["lcn"], state["lcn"]).alias("lcn"), F.concat(state["runs"], F.array(run)).alias("runs")).cast(kind))

        heads = F.struct(digit(state["at"]).alias("m"), digit(state["at"] + 1).alias("n"))
        return F.when(state["at"] > F.length(hexed), state).otherwise(once(heads, lambda head: F.when(head["n"] == 0, over).otherwise(body(head))))

    # a run takes two bytes at least
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.length(hexed) / 4).cast("int"), F.lit(1)))
    return F.when(hexed.isNotNull(), F.aggregate(steps, start, step, lambda s: s["runs"]))
