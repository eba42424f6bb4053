"""Spark's own Bloom filter, as an aggregate and a predicate inside the JVM.

The engine builds such filters itself for runtime join pruning; here they are reached on purpose. Their size is bounded by
``spark.sql.optimizer.runtime.bloomFilter.maxNumBits`` (8 MB by default), whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound of the filter's size in bits, which is the engine's own (8 MB). More keys than about an eighth of it only mean more rows to verify.
MAX_BITS = 1 << 26
#: A key takes so many bits, which lets about one foreign key in a hundred through.
BITS_A_KEY = 10


def _jvm(frame: DataFrame):
    return frame.sparkSession._jvm


def bloom_filter(keys: DataFrame, column: str, max_bits: int = MAX_BITS, items: int | None = None) -> DataFrame:
    """One row, one column ``filter``: the filter of the non-null values of ``column``, built by partial aggregation. Null of an empty table.

    ``items`` is about how many different keys there are, if that is known; the filter is then as large as they need, up to ``max_bits``. Else it
    has 1 MB.
    """
    jvm = _jvm(keys)
    bits = min(max_bits, 1 << 23 if items is None else max(1 << 16, items * BITS_A_KEY))
    hashed = keys.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    module = getattr(getattr(jvm.org.apache.spark.sql, "Column$"), "MODULE$")
    inputs = [F.col("h"), F.lit(max(1, bits // BITS_A_KEY)).cast("bigint"), F.lit(bits).cast("bigint")]
    built = Column(module.internalFn("bloom_filter_agg", jvm.org.apache.spark.api.python.PythonUtils.toSeq([c._jc for c in inputs])))
    return hashed.agg(built.alias("filter"))


def might_contain(filters: DataFrame, value: Column) -> Column:
    """False only if ``value`` is surely none of the filter's keys. The filter is a subquery: it is sent to the executors once, and no
    plan holds its bytes."""
    jvm = _jvm(filters)
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    held, hashed = utils.expression(filters.scalar()._jc), utils.expression(F.xxhash64(value)._jc)
    test = Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(held, hashed)))
    return F.coalesce(test, F.lit(False))
