"""Semantic types of single values: one chain of conditions, no Python in the workers.

The first rule that holds decides. ``now`` is a parameter, so results don't change from day to day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
#: Numbers are times only from here on.
FIRST_YEAR_SECONDS = 1_199_145_600

# Forms of values.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONES = (r"^\+?\d{8,14}$", r"^\d{2,4}-\d{3,4}-\d{4}$", r"^\+\d{1,3}-\d{1,4}-\d{3,4}-\d{4}$", r"^\(\d{2,4}\) ?\d{3,4}-\d{4}$")
IP = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
MAC = r"^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"
COORDINATE = r"^-?\d{1,3}\.\d{3,}$"
URL = r"^(?i:https?://|www\.)\S+$"
PACKAGE = r"^[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*){1,7}$"
PATH = r"^(?:/|[A-Za-z]:[\\/]|file:|content:)[^\n]*$"
TIMES = (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?", r"^\d{4}[./]\d{2}[./]\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?$")


def value_class(value: Column) -> Column:
    """int, float, negative, alpha, alnum, text or unknown (null and blank)."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "unknown")
        .when(value.rlike(r"^\d+$"), "int")
        .when(value.rlike(r"^\d+\.\d+$"), "float")
        .when(value.rlike(r"^-\d+(?:\.\d+)?$"), "negative")
        .when(value.rlike(r"^\p{L}+$"), "alpha")
        .when(value.rlike(r"^[\p{L}\p{N}]+$"), "alnum")
        .otherwise("text")
    )


def to_be_skipped(value: Column, column: Column) -> Column:
    """Values that say nothing: short ones, null words, zero, negative numbers (unless they look like coordinates), and numbers in columns of ids."""
    upper = F.upper(column)
    return (
        value.isNull()
        | (F.length(F.trim(value)) <= 3)
        | F.upper(value).isin("TRUE", "FALSE", "NULL", "NONE")
        | value.rlike(r"^0+(?:\.0+)?$")
        | (value.rlike(r"^-\d+(?:\.\d+)?$") & ~value.rlike(COORDINATE))
        | ((upper.endswith("_ID") | (upper == "ID") | column.endswith("ID")) & value.rlike(r"^\d+$"))
    )


def time_unit(value: Column, column: Column, now: int) -> Column:
    """The unit of a number that is a time between 2008 and ``now`` (any time in columns that tell of expiry), else null."""
    n, number = F.length(value), value.try_cast("decimal(20,0)")
    any_time = F.upper(column).contains("EXPIR")

    def within(seconds: Column) -> Column:
        return any_time | seconds.between(FIRST_YEAR_SECONDS, now)

    date = F.try_to_timestamp(F.substring(value, 1, 8), F.lit("yyyyMMdd"))
    return F.when(
        value.rlike(r"^\d+$"),
        F.when((n == 10) & within(number), "unixtime")
        .when((n == 13) & within(number / 1_000), "unixtime_millisec")
        .when((n == 16) & within(number / 1_000_000), "unixtime_microsec")
        .when((n == 19) & within(number / 1_000_000_000), "unixtime_nanosec")
        .when((n == 17) & within(number / 1_000_000 - 11_644_473_600), "chrome_time")
        .when((n == 8) & date.isNotNull() & within(F.unix_timestamp(date)), "yyyymmdd")
        .when((n == 14) & date.isNotNull() & within(F.unix_timestamp(date)), "yyyymmddhhmmss"),
    )


def semantic_type(value: Column, column: Column, now: int = 1_767_225_600) -> Column:
    """(type, format) of a value in a column of that name."""
    upper = F.upper(column)
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    no_phone = upper.contains("TIME") | upper.contains("VERSION") | upper.contains("KEY")
    phone = F.lit(False)
    for p in PHONES:
        phone = phone | value.rlike(p)
    time_text = F.lit(False)
    for p in TIMES:
        time_text = time_text | value.rlike(p)
    unit, number = time_unit(value, column, now), value.try_cast("double")
    where = F.floor(F.abs(number))

    def as_type(kind: str, form: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(form) if isinstance(form, str) else form).alias("format"))

    return (
        F.when(to_be_skipped(value, column), as_type(UNKNOWN, UNKNOWN))
        .when(unit.isNotNull(), as_type("TIMESTAMP", unit))
        .when(time_text, as_type("TIMESTAMP", "datetime"))
        .when(value.rlike(EMAIL) & F.length(value).between(10, 50), as_type("ACCOUNT", "email"))
        .when(value.rlike(IP), as_type("IP", "ipv4"))
        .when(value.rlike(MAC), as_type("MAC", "mac"))
        .when((F.length(value) >= 15) & value.rlike(URL), as_type("URL", "url"))
        .when(phone & ~no_phone & (digits > 7) & (digits < 15), as_type("PHONE", "phonenumber"))
        .when(value.rlike(COORDINATE) & where.between(123, 133), as_type("GEODATA", "longitude"))
        .when(value.rlike(COORDINATE) & where.between(31, 40), as_type("GEODATA", "latitude"))
        .when(value.rlike(r"^\d+$") & (upper.contains("LONGITUDE") | upper.isin("LNG", "LON")), as_type("GEODATA", "longitude"))
        .when(value.rlike(r"^\d+$") & (upper.contains("LATITUDE") | (upper == "LAT")), as_type("GEODATA", "latitude"))
        .when(value.rlike(PATH), as_type("FILE", "path"))
        .when(upper.contains("PASSW") | upper.contains("PWD"), as_type("PASSWORD", "string"))
        .when(upper.contains("CIPHER") | upper.contains("ENCRYPT"), as_type("CIPHER", "string"))
        .when(value.rlike(PACKAGE) & (F.length(value) <= 60) & value.contains("."), as_type("PACKAGE", "package"))
        .when((upper.contains("DURATION") | upper.contains("SECONDS")) & value.rlike(r"^\d+$"), as_type("DURATION", "digit_positive"))
        .when((upper.contains("SIZE")) & value.rlike(r"^\d+$"), as_type("FILE", "size"))
        .otherwise(as_type(UNKNOWN, UNKNOWN))
    )
