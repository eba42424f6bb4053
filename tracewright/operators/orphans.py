"""References to parents that are absent, deleted or not yet loaded.

A Bloom filter of all parent keys proves most dangling references in the scan of the child table. Only references that the filter
lets through are joined with the parents, which are first reduced to one row a key: its first loading and the intervals in which it
was present. Loadings are reduced by plain aggregation, so a parent key that was loaded a million times costs no more than another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.bloom import MAX_BITS, bloom_filter, might_contain
from tracewright.session import BROADCAST_ROWS, lookup

FAR_FUTURE = "9999-12-31 23:59:59"


@dataclass(frozen=True)
class Reference:
    """A child table's column that names a key of a parent table."""

    child: str
    column: str
    parent: str
    key: str


def same_key(text: Column) -> Column:
    """Keys are the same if they differ only in letter case, surrounding white space and hyphens. Blank gives null."""
    return F.nullif(F.lower(F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("-"), F.lit(""))), F.lit(""))


def presence(parents: DataFrame, key: str, deletions: DataFrame, loaded: str = "loaded_at") -> DataFrame:
    """(key, first_load, spans): when each key of ``parents`` was present.

    ``deletions`` has (key_value, deleted_at). A deletion ends the presence of every loading at or before it. Of the loadings between
    two deletions only the first matters, so they are reduced with partial aggregation to one a key and next deletion; a key has at
    most one span more than distinct deletions.
    """
    loads = parents.select(same_key(F.col(key)).alias("key"), F.col(loaded).alias("at")).filter("key is not null and at is not null")
    gone = deletions.select(same_key(F.col("key_value")).alias("key"), F.col("deleted_at").alias("gone_at")).filter("key is not null and gone_at is not null")
    gone = gone.groupBy("key").agg(F.sort_array(F.collect_set("gone_at")).alias("gone"))
    # repeated loadings at one time are reduced before the join, so that hot keys are small there
    ended = loads.groupBy("key", "at").agg(F.lit(1).alias("one")).join(gone, "key", "left")
    ended = ended.withColumn("until", F.array_min(F.filter("gone", lambda d: d >= F.col("at"))))
    spans = ended.groupBy("key", "until").agg(F.min("at").alias("since"))
    return spans.groupBy("key").agg(F.min("since").alias("first_load"), F.collect_list(F.struct("since", "until")).alias("spans"))


def orphans(child: DataFrame, column: str, parents: DataFrame, key: str, deletions: DataFrame, row: str = "row_id", loaded: str = "loaded_at", max_bits: int = MAX_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, reason, period) of each row of ``child`` with a non-blank reference whose parent isn't present at the row's ``loaded``.

    reason: ``missing`` (no such key at all), ``late`` (first loaded later) or ``deleted``. period: ``yyyy-MM`` of ``loaded``; null where
    ``loaded`` is null, and such a row is an orphan only if the key is missing. Null and blank references are none. Repeated rows are
    reported each. An empty parent table makes every reference an orphan, an empty child table gives no row.
    """
    refs = child.select(F.col(row).alias("row"), same_key(F.col(column)).alias("key"), F.col(loaded).alias("seen")).filter("key is not null")
    refs = refs.withColumn("period", F.date_format("seen", "yyyy-MM"))
    keys = parents.select(same_key(F.col(key)).alias("key"))
    known = bloom_filter(keys, "key", max_bits, items=parents.count())
    # A reference that the filter rejects is proven to be an orphan: it goes on without a key, so it takes no part in the join (and is spread
    # evenly if the join shuffles).
    refs = refs.withColumn("key", F.when(might_contain(known, F.col("key")), F.col("key")))
    checked = lookup(refs, presence(parents, key, deletions), "key", "row", rows=broadcast_rows)
    there = F.exists("spans", lambda s: (s["since"] <= F.col("seen")) & (s["until"].isNull() | (s["until"] > F.col("seen"))))
    reason = (
        F.when(F.col("first_load").isNull(), "missing")
        .when(F.col("seen").isNull() | there, F.lit(None))
        .when(F.col("first_load") > F.col("seen"), "late")
        .otherwise("deleted")
    )
    return checked.select(F.col("row").alias(row), reason.alias("reason"), "period").filter("reason is not null")


def orphans_of(references: list[Reference], tables: dict[str, DataFrame], deletions: DataFrame, **options) -> DataFrame:
    """(table_name, row_id, reason, period) over several references; ``deletions`` also has table_name, the parent's."""
    parts = []
    for r in references:
        gone = deletions.filter(F.col("table_name") == r.parent)
        found = orphans(tables[r.child], r.column, tables[r.parent], r.key, gone, **options)
        parts.append(found.select(F.lit(r.child).alias("table_name"), "row_id", "reason", "period"))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(found: DataFrame) -> DataFrame:
    """Number of orphans per table, period and reason."""
    return found.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))
