"""Ordered operators over hot groups: cut into ranges and blocks they give what one window gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins as J
from tracewright.operators import windows as W


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([rng.randrange(1_000_000), 77]), rng.choice("xyz"), rng.choice(["f", "go", None])) for i in range(3000)]
    rows += [(i, "flat", 5, "x", "f") for i in range(3000, 3600)]  # all ties in the leading column
    return spark.createDataFrame(rows, "id int, par string, at bigint, k string, t string")




def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_positions(log):
    order = [F.col("at"), F.col("id")]
    same(W.positions(log, ["par"], order, "n"), W.positions(log, ["par"], order, "n", hot=40))


def test_lag_and_lookback(log):
    order = [F.col("at"), F.col("id")]
    linked = log.withColumn("link", F.col("id") - 1)
    same(W.chained(linked, ["par"], order, "link", "id", ["k", "t"]), W.chained(linked, ["par"], order, "link", "id", ["k", "t"], hot=40))
    for distance, found in ((25, 1), (20, 2), (60, 3)):
        one, cut = (W.looked_back(log, ["par"], order, distance, "k", F.col("t") == "go", "id", "near", found, hot=hot) for hot in (None, 40))
        same(one, cut)


def test_merged_lines_and_zips(log):
    starts = F.col("k") == "x"
    lines = log.filter("par is not null").withColumn("o", F.col("at") * 10_000 + F.col("id"))
    same(W.merged_lines(lines, ["par"], "o", "k", starts), W.merged_lines(lines, ["par"], "o", "k", starts, hot=40))
    left, right = lines.filter("id % 2 = 0").select("par", "at", F.col("id").alias("l")), lines.filter("id % 3 = 0").select("par", F.col("at").alias("bt"), F.col("id").alias("r"))
    both = [J.zipped(left, right, [F.col("at"), F.col("l")], [F.col("bt"), F.col("r")], ["par"], hot=hot) for hot in (None, 40)]
    same(*both)


def test_first_rows_and_longest(spark, log):
    got = W.first_rows(log, ["par"], ["at", "id"]).filter("is_first")
    want = log.groupBy("par").agg(F.min(F.struct("at", "id")).alias("m")).select("m.id")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}
    frame = spark.createDataFrame([(["a", "bbb", "ccc"],), ([],), (None,)], "n array<string>")
    assert [r[0] for r in frame.select(W.longest(F.col("n"))).collect()] == ["bbb", None, None]
    assert W.positions(log.limit(0), ["par"], [F.col("at")]).count() == 0


def test_all_runs(spark):
    frame = spark.createDataFrame([("21180006" + "1105F0" + "0109" + "00",), ("",), ("00",), (None,)], "h string")
    got = [r[0] if r[0] is None else [(x["length"], x["lcn"]) for x in r[0]] for r in frame.select(W.data_runs(F.col("h"))).collect()]
    assert got == [[(0x18, 0x600), (5, 0x600 - 16), (9, None)], [], [], None]
