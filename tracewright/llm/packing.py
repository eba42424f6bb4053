"""Filling containers of fixed capacity with items that aren't split unless they exceed it.

An item beyond the capacity is cut into pieces of the capacity, which fill a container each and need no packing, and a rest. Rests and whole
items are dealt at random (by hash) to groups of about ``GROUP_ITEMS``; each group is packed on its own by first-fit decreasing, where a
tournament tree over the bins' free space finds the first bin that fits in logarithmic time. An item has at most one piece to pack, so a
group's size depends neither on any key of the data nor on the length of a text; the price is at most one half-filled bin a group more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 8192
#: A table of more classes than this is refused: every class is a packing of all items of its own.
MAX_CLASSES = 1000


class Tournament:
    """The largest free space of each subtree of bins; bins are opened as needed."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.leaves = capacity, 0, 1
        self.free = [0, 0]

    def _grow(self) -> None:
        old = self.free[self.leaves : self.leaves + self.bins]
        self.leaves *= 2
        self.free = [0] * (2 * self.leaves)
        self.free[self.leaves : self.leaves + self.bins] = old
        for i in range(self.leaves - 1, 0, -1):
            self.free[i] = max(self.free[2 * i], self.free[2 * i + 1])

    def place(self, size: int) -> int:
        """The first bin with ``size`` free, which it then takes; a new one if there is none."""
        free = self.free
        if self.bins and free[1] >= size:
            i = 1
            while i < self.leaves:
                i = 2 * i if free[2 * i] >= size else 2 * i + 1
                if i >= self.leaves:
                    break
            at = i - self.leaves
            if at >= self.bins:  # size 0 may run past the open bins
                at = 0
        else:
            if self.bins == self.leaves:
                self._grow()
                free = self.free
            at = self.bins
            self.bins += 1
            free[self.leaves + at] = self.capacity
        i = self.leaves + at
        free[i] -= size
        i //= 2
        while i:
            best = free[2 * i] if free[2 * i] >= free[2 * i + 1] else free[2 * i + 1]
            free[i] = best
            i //= 2
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are between 0 and ``capacity``. Ties keep their order."""
    out, tree = np.zeros(len(sizes), np.int64), Tournament(capacity)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(items: DataFrame, row: str, size: str, containers: DataFrame, name: str, capacity: str, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(name, container, row, piece, start, size): which container each piece of each item lies in, for each class in ``containers``.

    An item up to the capacity is one piece (0). A larger one is cut into pieces of the capacity and a rest. ``container`` is unique within the
    class. Items of size 0 or null are one piece of size 0. ``containers`` is a small table of classes (it is read by the driver, ``MAX_CLASSES``
    at most); classes with a null or non-positive capacity are left out. Repeated rows are packed each. Empty items give no row.
    ``items`` should be cut off from its lineage, as the numbers of containers of full pieces follow its order.
    """
    classes = [(r[name], int(r[capacity])) for r in containers.filter(F.col(capacity) > 0).select(name, capacity).limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes of containers")
    spark, kind = items.sparkSession, items.schema[row].dataType.simpleString()
    total = items.count()
    groups = max(1, -(-total // group_items))
    listed = F.array(*(F.struct(F.lit(n).alias("cls"), F.lit(c).cast("bigint").alias("cap")) for n, c in classes)) if classes else F.expr("cast(array() as array<struct<cls:string,cap:bigint>>)")
    sized = items.select(F.col(row).alias("r"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("s"))
    each = sized.select("r", "s", F.explode(listed).alias("c")).select("r", "s", "c.cls", "c.cap")
    each = each.withColumn("full", F.floor(F.col("s") / F.col("cap"))).withColumn("rest", F.col("s") - F.col("full") * F.col("cap"))
    full = each.filter("full > 0").select("cls", "cap", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    # odd numbers are containers of one full piece, even ones those of the groups
    full = full.select("cls", (F.monotonically_increasing_id() * 2 + 1).alias("container"), "r", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("s"))
    rests = each.filter("rest > 0 or full = 0").select("cls", "cap", "r", F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("start"), F.col("rest").alias("s"))
    rests = rests.withColumn("g", F.pmod(F.xxhash64("r", "piece"), F.lit(groups)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["r", "piece"], kind="stable")
        bins = first_fit_decreasing(part["s"].to_numpy(), int(part["cap"].iloc[0]))
        part["container"] = 2 * (bins * groups + int(part["g"].iloc[0]))
        return part[["cls", "container", "r", "piece", "start", "s"]]

    packed = rests.groupBy("cls", "g").applyInPandas(run, f"cls string, container bigint, r {kind}, piece bigint, start bigint, s bigint")
    out = packed.unionByName(full)
    return out.select(F.col("cls").alias(name), "container", F.col("r").alias(row), "piece", "start", F.col("s").alias("tokens"))


def fill_report(packed: DataFrame, containers: DataFrame, name: str, capacity: str) -> DataFrame:
    """(name, containers, tokens, fill): how many containers each class took and how full they are."""
    per = packed.groupBy(name, "container").agg(F.sum("tokens").alias("t"))
    per = per.groupBy(name).agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    joined = per.join(containers.select(name, F.col(capacity).cast("bigint").alias("_cap")), name)
    return joined.select(name, "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("_cap")), 6).alias("fill"))
