import random
from datetime import datetime, timedelta

import pytest

from tracewright.operators.orphans import orphan_report, orphans, orphans_of, Reference

START = datetime(2022, 1, 1)


def norm(k):
    k = (k or "").strip().lower().replace("-", "")
    return k or None


def brute(child, parents, gone):
    out = {}
    for row, key, t in child:
        k = norm(key)
        if not k:
            continue
        loads = [a for p, a in parents if norm(p) == k]
        if any(a <= t and not any(norm(d) == k and a <= g <= t for d, g in gone) for a in loads):
            continue
        out[row] = "missing" if not loads else "late" if min(loads) > t else "deleted"
    return out


@pytest.mark.parametrize("limit", [0, 1000])
def test_against_brute_force(spark, limit):
    rng = random.Random(5)
    at = lambda: START + timedelta(days=rng.randrange(60))
    spell = lambda k: rng.choice((k, k.upper(), f" {k}", f"{k[:2]}-{k[2:]}", f"\t{k}"))
    keys = [f"k{i:04d}" for i in range(30)]
    parents = [(spell(rng.choice(keys[:24])), at()) for _ in range(60)] + [("k0001", START)] * 200
    gone = [(spell(rng.choice(keys)), at()) for _ in range(25)]
    child = [(i, rng.choice([spell(rng.choice(keys)), None, "", "  ", "k0001"]), at()) for i in range(500)]
    c = spark.createDataFrame(child, "row_id bigint, ref string, loaded_at timestamp_ntz").withColumn  # noqa: F841
    frames = [spark.createDataFrame(x, s) for x, s in ((child, "row_id bigint, ref string, loaded_at timestamp_ntz"), (parents, "id string, loaded_at timestamp_ntz"), (gone, "key_value string, deleted_at timestamp_ntz"))]
    got = orphans(frames[0], "ref", frames[1], "id", frames[2], broadcast_rows=limit).collect()
    assert {r["row_id"]: r["reason"] for r in got} == brute(child, parents, gone)
    assert {r["period"] for r in got} <= {"2022-01", "2022-02", "2022-03"}


def test_empty_tables(spark):
    child = spark.createDataFrame([(1, "a", START), (2, None, START)], "row_id bigint, ref string, loaded_at timestamp_ntz")
    parents = spark.createDataFrame([], "id string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([], "table_name string, key_value string, deleted_at timestamp_ntz")
    assert [tuple(r) for r in orphans(child, "ref", parents, "id", gone).collect()] == [(1, "missing", "2022-01")]
    assert orphans(child.limit(0), "ref", parents, "id", gone).count() == 0
    report = orphan_report(orphans_of([Reference("c", "ref", "p", "id")], {"c": child, "p": parents}, gone))
    assert [tuple(r) for r in report.collect()] == [("c", "2022-01", "missing", 1)]


def test_clashing_columns_nulls_and_repeats(spark):
    child = spark.createDataFrame([(1, "A", START, "x", None, 5), (1, "A", START, "x", None, 5), (2, "b" * 100_000, START, None, "y", None), (3, "a", None, None, None, None)], "row_id bigint, ref string, loaded_at timestamp_ntz, key string, spans string, first_load int")
    parents = spark.createDataFrame([("a", START, 1), (None, START, 1), ("a", None, 1)], "id string, loaded_at timestamp_ntz, seen int")
    gone = spark.createDataFrame([("a", START), (None, START), ("a", None)], "key_value string, deleted_at timestamp_ntz")
    got = sorted((r["row_id"], r["reason"]) for r in orphans(child, "ref", parents, "id", gone).collect())
    assert got == [(1, "deleted"), (1, "deleted"), (2, "missing")]
