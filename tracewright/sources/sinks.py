"""Schemas by declaration, tables that are made when absent, appends and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Declared types and the engine's own.
TYPES = {"TEXT": "string", "VARCHAR": "string", "CHAR": "string", "DATETIME": "timestamp", "BIGINT": "bigint", "INT": "int", "INTEGER": "bigint", "BOOLEAN": "boolean", "BLOB": "binary", "LONGBLOB": "binary"}


def declared_schema(columns: list[str], types: list[str] | None = None) -> StructType:
    """Columns and their declared types; missing types are text, surplus ones are ignored."""
    kinds = [*(types or []), *["TEXT"] * len(columns)][: len(columns)]
    return StructType.fromDDL(", ".join(f"`{c}` {TYPES.get(t.split('(')[0].strip().upper(), 'string')}" for c, t in zip(columns, kinds, strict=True)))


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> None:
    """Make the table if it is absent."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name, format="parquet")


def table_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """The table, or no rows of the same schema if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def append(frame: DataFrame, name: str) -> None:
    """Append by column name; the table's other columns become null."""
    have = frame.sparkSession.table(name).schema
    frame.select(*(F.col(f.name).cast(f.dataType) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have)).write.insertInto(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def updated(frame: DataFrame, changes: dict) -> DataFrame:
    """Rows with some columns changed: column -> (condition, value). What an UPDATE in place would leave."""
    return frame.select(*(F.when(changes[c][0], changes[c][1]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in frame.columns))


def with_index(frame: DataFrame, name: str = "index") -> DataFrame:
    """``frame`` with its rows numbered 0, 1, 2 ... in the order of its partitions; the numbers of partitions are added up, so no row moves."""
    rows = frame.select(F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"), *frame.columns)
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as there are partitions
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("_part")).cast("bigint") if starts else F.lit(0).cast("bigint")
    return rows.select((F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33) + start).alias(name), *frame.columns)


def send_batches(frame: DataFrame, send: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hand the rows to ``send`` in lists of up to ``size``, on the executors. A task that is repeated sends again, so ids should make that harmless."""

    def run(rows) -> None:
        waiting: list[dict] = []
        for row in rows:
            waiting.append(row.asDict(recursive=True))
            if len(waiting) >= size:
                send(waiting)
                waiting = []
        if waiting:
            send(waiting)

    frame.foreachPartition(run)


def append_jdbc(frame: DataFrame, url: str, name: str, properties: dict[str, str] | None = None) -> None:
    """Append to a table of another database, which is made if it is absent."""
    frame.write.mode("append").jdbc(url, name, properties=properties or {})


def named_table(spark: SparkSession, names: DataFrame, column: str) -> DataFrame:
    """The table whose name stands in the first row of ``names``; no row is an error."""
    found = names.select(column).filter(F.col(column).isNotNull()).orderBy(column).first()
    if found is None:
        raise LookupError(f"no table is named in {column}")
    return spark.table(found[0])


def export_csv(frame: DataFrame, path: str, mark: bool = False, index: bool = False) -> None:
    """CSV with a header, in as many files as partitions; ``mark`` puts a byte-order mark before the first column's name, ``index`` numbers the rows."""
    frame = with_index(frame) if index else frame
    if mark:
        frame = frame.withColumnRenamed(frame.columns[0], "﻿" + frame.columns[0])
    frame.write.mode("overwrite").option("header", True).csv(path)


def export_all(spark: SparkSession, names: list[str], folder: str) -> None:
    """Every table and view that exists, each in its own folder."""
    for n in names:
        if spark.catalog.tableExists(n):
            export_csv(spark.table(n), f"{folder}/{n}")
