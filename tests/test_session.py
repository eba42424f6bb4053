"""Checked broadcasts, lookups with hot and null keys, sized Bloom filters."""

from pyspark.sql import functions as F

from tracewright.functions.bloom import bloom_filter, might_contain
from tracewright.session import SALTS, fits, lookup


def keyed(spark, n=20_000):
    """Nine tenths of the rows have no key, and half of the others have the same."""
    key = F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))))
    return spark.range(n).select("id", key.alias("key"))


def test_null_and_hot_keys_are_spread(spark):
    small = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("hot", -1)], "key string, v bigint"))
    facts = keyed(spark)
    want = sorted((r["id"], r["v"]) for r in lookup(facts, small, "key", "id").collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = lookup(facts, small, "key", "id", rows=10)
        assert sorted((r["id"], r["v"]) for r in shuffled.collect()) == want
        sizes = [r["count"] for r in shuffled.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 40 and max(sizes) < 2 * 20_000 / 40 + 20_000 / 20 / SALTS * 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_broadcast_is_measured_in_rows_and_bytes(spark):
    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits(few) and not fits(few, rows=9) and not fits(few, size=5_000) and fits(few.limit(0))


def test_filters_are_as_large_as_their_keys_need(spark):
    keys = spark.range(50_000).withColumnRenamed("id", "k")
    held = bloom_filter(keys, "k", items=50_000)
    size = len(held.first()["filter"])
    assert 50_000 < size < 80_000 and len(bloom_filter(keys, "k", max_bits=1 << 16, items=50_000).first()["filter"]) < 9_000
    others = spark.range(100_000, 150_000)
    assert keys.filter(~might_contain(held, F.col("k"))).count() == 0
    assert others.filter(might_contain(held, F.col("id"))).count() < 2_500
