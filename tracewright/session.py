"""Session helpers: table loading, checked broadcasts, skew-safe lookups and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

#: A lookup table is broadcast only if it was measured to have at most this many rows and about this many bytes ...
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: ... and is otherwise joined by shuffle, with each of its rows repeated for this many salts of the fact side.
SALTS = 16


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the directory ``directory``; columns are pruned and filters pushed down by the Parquet scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone that holds UTC, whatever the session's time zone is."""
    zoneless = column.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), zoneless)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``; only a local master gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the reliable checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fits(frame: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``frame`` was measured to be small enough for a broadcast, arrays and long texts counted in."""
    parts, fixed = [], 0
    for f in frame.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.length(f.name), F.lit(0)))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)):
            parts.append(F.length(F.to_json(F.struct(f.name))))
        else:
            fixed += 8
    n, total = frame.agg(F.count(F.lit(1)), F.sum(sum(parts, F.lit(0).cast("bigint")))).first()
    return n <= rows and n * fixed + (total or 0) <= size


def lookup(facts: DataFrame, small: DataFrame, key: str | list[str], salt_by: str, how: str = "left", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` to the unique-key table ``small``.

    ``small`` is measured first. Up to ``rows`` rows and ``size`` bytes it is broadcast; beyond, both sides are shuffled on (key, salt), so that a
    key that holds a third of ``facts`` is spread over ``SALTS`` tasks (with ``rows`` of 0 at once; adaptive execution may still broadcast what turns
    out to be small). Null keys match nothing; each gets a salt of its own, so however many
    there are they are spread over all tasks.
    """
    on = [key] if isinstance(key, str) else key
    if rows and fits(small, rows, size):
        return facts.join(F.broadcast(small), on, how)
    null = F.greatest(*(F.col(k).isNull() for k in on), F.lit(False))
    salted = facts.withColumn("_salt", F.when(null, F.xxhash64(salt_by)).otherwise(F.pmod(F.xxhash64(salt_by), F.lit(SALTS))))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def spread(frame: DataFrame) -> DataFrame:
    """Deal the rows of a scan anew if it has fewer partitions than there are cores, as one small file has; other inputs stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
