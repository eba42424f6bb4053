"""Times of many systems to timestamps and texts. Unless said otherwise null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01 to 1970-01-01.
EPOCH_GAP = 11_644_473_600


def unix_micros_of_filetime(seconds: Column, ticks: Column) -> Column:
    """Seconds since 1601 and a fraction in 100 ns -> microseconds since 1970."""
    return (seconds - EPOCH_GAP) * 1_000_000 + F.floor(ticks / 10).cast("bigint")


def filetime(ticks: Column) -> Column:
    """100 ns since 1601 -> timestamp; the last digit is cut off."""
    return F.timestamp_micros(((ticks - F.pmod(ticks, F.lit(10))).cast("decimal(20,0)") / 10).cast("bigint") - EPOCH_GAP * 1_000_000)


def browser_time(value: Column) -> Column:
    """Microseconds since 1601 as text -> ISO text; 0 gives the empty string, more than 18 digits pass through."""
    micros = value.try_cast("bigint") - EPOCH_GAP * 1_000_000
    return F.when(value == "0", F.lit("")).when(F.length(value) <= 18, F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(value)


def unix_by_length(value: Column) -> Column:
    """13 digits are milliseconds, 16 microseconds since 1970; other lengths give null."""
    n = F.length(value.cast("string"))
    return F.when(n == 13, F.timestamp_millis(value.try_cast("bigint"))).when(n == 16, F.timestamp_micros(value.try_cast("bigint")))


def iso_of_seconds(seconds: Column) -> Column:
    """Seconds since 1970 -> ISO text in UTC, whatever zone the session or machine has."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")


def millis_text(millis: Column, pattern: str) -> Column:
    """Milliseconds since 1970 -> text; ``pattern`` has the marks %Y %m %d %H %i %s of SQL dialects. 0 gives ''."""
    for mark, own in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%i", "mm"), ("%s", "ss")):
        pattern = pattern.replace(mark, own)
    return F.when(millis == 0, "").otherwise(F.date_format(F.timestamp_millis(millis), pattern))


def millis_in_zone(millis: Column, zone: str) -> Column:
    """Milliseconds since 1970 -> the local time in ``zone`` as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(millis), zone), "yyyy-MM-dd HH:mm:ss")


def by_file_system(kind: Column, value: Column, fraction: Column) -> Column:
    """Microseconds since 1970 of a file's time as its source keeps it: ``tsk`` seconds and nanoseconds since 1970, ``ntfs`` seconds since 1601 and a
    fraction in 100 ns, ``os`` hundredths of a second since 1970. Null for other kinds."""
    return (
        F.when(kind == "tsk", value * 1_000_000 + F.floor(fraction / 1000).cast("bigint"))
        .when(kind == "ntfs", unix_micros_of_filetime(value, fraction))
        .when(kind == "os", value * 10_000)
    )


def filetime_of_bytes(content: Column) -> Column:
    """Eight bytes, big endian, of 100 ns since 1601 -> timestamp; null for other lengths and times beyond the range."""
    ticks = F.conv(F.hex(content), 16, 10).try_cast("decimal(20,0)")
    return F.when((F.length(content) == 8) & (ticks < F.lit(2).cast("decimal(20,0)") * (1 << 62)), filetime(ticks.try_cast("bigint")))


def mail_time(value: Column) -> Column:
    """``Tue, 05 Mar 2024 10:11:12 GMT`` -> timestamp; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def in_zone(value: Column, zone: Column | str) -> Column:
    """A UTC text shown in ``zone`` with its offset. Null, '' and '0' pass through, what is no time gives '0'."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    utc = F.try_to_timestamp(value)
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(utc)) / 60_000_000).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.abs(minutes), F.lit(60)).cast("string"), 2, "0"))
    shown = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return F.when(value.isNull() | value.isin("", "0"), value).when(utc.isNull(), F.lit("0")).otherwise(shown)


def duration_text(seconds: Column) -> Column:
    """Whole seconds -> ``h:mm:ss``, with ``n day(s), `` before it from a day on; negative ones count from the day below."""
    days, rest = F.floor(seconds / 86_400), F.pmod(seconds, F.lit(86_400))
    clock = F.concat_ws(":", F.floor(rest / 3600).cast("string"), F.lpad(F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("string"), 2, "0"), F.lpad(F.pmod(rest, F.lit(60)).cast("string"), 2, "0"))
    word = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), word, clock))


def epoch_switched(seconds: Column, *others: Column) -> Column:
    """Seconds since 1970 of a value that may count from 1601: it does if it or any of ``others`` is beyond the gap between the epochs."""
    far = F.greatest(seconds, *others) > EPOCH_GAP if others else seconds > EPOCH_GAP
    return F.when(far, seconds - EPOCH_GAP).otherwise(seconds)


def after_epoch(text: Column) -> Column:
    """True for texts of a time after 1970-01-01; false for everything else, null included."""
    return F.coalesce(F.try_to_timestamp(text) > F.lit("1970-01-01").cast("timestamp"), F.lit(False))
