import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tracewright.operators.timestamps import normalise_timestamps

EVIDENCE = [("e1", "Europe/Berlin"), ("e2", "GMT-8"), ("e3", "Etc/GMT+5"), ("e4", "N/A"), ("e5", "(UTC+09:00) Seoul"), ("e6", "eastern standard time"), ("e7", None), ("e8", "UTC+5:30"), ("e9", " america/st_johns ")]


def run(spark, rows, evidence=EVIDENCE, **options):
    frame = spark.createDataFrame([(i, e, t, "x") for i, (e, t) in enumerate(rows)], "row_id bigint, evd_id string, timestamp string, zone string")
    out = normalise_timestamps(frame, spark.createDataFrame(evidence, "evd_id string, timezone string"), **options)
    return {r["row_id"]: (r["utc_us"], r["status"]) for r in out.collect()}


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("e1", "2022-07-25T18:21:06.1342784Z", us(2022, 7, 25, 18, 21, 6) + 134278, "ok"),
    ("e1", "2022-07-25 18:21:06", us(2022, 7, 25, 16, 21, 6), "ok"),
    ("e1", "2022-03-27 02:30:00", None, "nonexistent"),
    ("e1", "2022-10-30 02:30:00", None, "ambiguous"),
    ("e1", "2022-10-30T02:30:00+01:00[Europe/Berlin]", us(2022, 10, 30, 1, 30), "ok"),
    ("e2", "2022-01-01 00:00", us(2022, 1, 1, 8), "ok"),
    ("e3", "20220101000000", us(2022, 1, 1, 5), "ok"),
    ("e4", "2022-01-01 00:00:00", None, "no_zone"),
    ("e5", "03/04/2023 12:05:06 AM", us(2023, 3, 3, 15, 5, 6), "ok"),
    ("e6", "03.04.2023 12:05:06", us(2023, 4, 3, 16, 5, 6), "ok"),
    ("E1", "2022-07-25 18:21:06", None, "no_zone"),
    (None, "2022-07-25 18:21:06", None, "no_zone"),
    (None, "2022-07-25 18:21:06 EST", us(2022, 7, 25, 23, 21, 6), "ok"),
    (None, "2022-07-25 18:21:06 Asia/Kolkata", us(2022, 7, 25, 12, 51, 6), "ok"),
    (None, "2022-07-25 18:21:06 Nowhere/Town", None, "no_zone"),
    ("e8", "Fri, 1 Nov 2024 04:42:03 +0530", us(2024, 10, 31, 23, 12, 3), "ok"),
    ("e8", "10 Apr 2024 09:36:48", us(2024, 4, 10, 4, 6, 48), "ok"),
    ("e9", "2023-07-01 00:00:00", us(2023, 7, 1, 2, 30), "ok"),
    (None, "1609493672426(date:unixtime_millisec)", 1609493672426000, "ok"),
    (None, "1609772512", 1609772512000000, "ok"),
    (None, "1612934709.899", 1612934709899000, "ok"),
    (None, "13277989822083577", 13277989822083577 - 11644473600000000, "ok"),
    (None, "132545159093252998", 13254515909325299 - 11644473600000000, "ok"),
    (None, "1609705011239106291", 1609705011239106, "ok"),
    (None, "1601-01-01T00:00:00Z", None, "empty"),
    ("e1", "1970-01-01 00:00:00", None, "empty"),
    (None, "0", None, "empty"),
    (None, "  ", None, "empty"),
    (None, None, None, "empty"),
    (None, "2023-02-30 11:04:09Z", None, "unreadable"),
    (None, "2021-06-31T25:61:00Z", None, "unreadable"),
    (None, "yesterday 10:42", None, "unreadable"),
    (None, "x" * 100_000, None, "unreadable"),
    ("e1", "13/40/2023 1:00:00 AM", None, "unreadable"),
    ("e1", "01/02/2023 13:00:00 AM", None, "unreadable"),
]


def test_cases(spark):
    got = run(spark, [(e, t) for e, t, _, _ in CASES])
    for i, (e, t, want, status) in enumerate(CASES):
        assert got[i] == (want, status), (e, t, got[i])


@pytest.mark.parametrize("limit", [0, 1000])
def test_against_zoneinfo(spark, limit):
    """Local times around clock changes; with limit 0 the evidence is joined by shuffle."""
    rng = random.Random(3)
    zones = ["Europe/London", "America/New_York", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kathmandu", "America/St_Johns"]
    rows, want = [], []
    for _ in range(400):
        z = rng.choice(zones)
        t = datetime(2021, 1, 1) + timedelta(minutes=rng.randrange(4 * 365 * 24 * 60)) if rng.random() < 0.4 else rng.choice([datetime(2022, 3, 27), datetime(2022, 10, 30), datetime(2023, 3, 12), datetime(2023, 11, 5), datetime(2023, 4, 2), datetime(2023, 10, 1)]) + timedelta(minutes=rng.randrange(240))
        rows.append((z, t.strftime("%Y-%m-%d %H:%M:%S")))
        both = {t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = [u for u in both if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == t]
        want.append(int(real[0].timestamp()) * 1_000_000 if len(real) == 1 else None)
    got = run(spark, rows, [(z, z) for z in zones], broadcast_rows=limit)
    assert [got[i][0] for i in range(len(rows))] == want


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    assert run(spark, [("e1", "1609772512")] * 3, []) == {i: (1609772512000000, "ok") for i in range(3)}
