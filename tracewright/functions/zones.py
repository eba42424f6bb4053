"""Time zones: spellings to zones, and local times to instants."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that systems use for zones, and the places whose clock changes they follow.
SYSTEM_NAMES = {
    "AUS Eastern Standard Time": "Australia/Sydney",
    "Alaskan Standard Time": "America/Anchorage",
    "Arabian Standard Time": "Asia/Dubai",
    "Argentina Standard Time": "America/Argentina/Buenos_Aires",
    "Atlantic Standard Time": "America/Halifax",
    "Cen. Australia Standard Time": "Australia/Adelaide",
    "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw",
    "Central Standard Time": "America/Chicago",
    "China Standard Time": "Asia/Shanghai",
    "E. Australia Standard Time": "Australia/Brisbane",
    "E. South America Standard Time": "America/Sao_Paulo",
    "Eastern Standard Time": "America/New_York",
    "Egypt Standard Time": "Africa/Cairo",
    "FLE Standard Time": "Europe/Kiev",
    "GMT Standard Time": "Europe/London",
    "GTB Standard Time": "Europe/Bucharest",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "India Standard Time": "Asia/Kolkata",
    "Israel Standard Time": "Asia/Jerusalem",
    "Korea Standard Time": "Asia/Seoul",
    "Lord Howe Standard Time": "Australia/Lord_Howe",
    "Mountain Standard Time": "America/Denver",
    "Nepal Standard Time": "Asia/Kathmandu",
    "New Zealand Standard Time": "Pacific/Auckland",
    "Newfoundland Standard Time": "America/St_Johns",
    "Pacific Standard Time": "America/Los_Angeles",
    "Romance Standard Time": "Europe/Paris",
    "Russian Standard Time": "Europe/Moscow",
    "SE Asia Standard Time": "Asia/Bangkok",
    "Singapore Standard Time": "Asia/Singapore",
    "South Africa Standard Time": "Africa/Johannesburg",
    "Taipei Standard Time": "Asia/Taipei",
    "Tasmania Standard Time": "Australia/Hobart",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Turkey Standard Time": "Europe/Istanbul",
    "US Mountain Standard Time": "America/Phoenix",
    "W. Australia Standard Time": "Australia/Perth",
    "W. Europe Standard Time": "Europe/Berlin",
}
# Cities in the display names of systems, as in "(UTC+09:00) Seoul".
DISPLAY_CITIES = {
    "Seoul": "Asia/Seoul",
    "Osaka, Sapporo, Tokyo": "Asia/Tokyo",
    "Amsterdam, Berlin, Bern, Rome, Stockholm, Vienna": "Europe/Berlin",
    "Dublin, Edinburgh, Lisbon, London": "Europe/London",
    "Eastern Time (US & Canada)": "America/New_York",
    "Pacific Time (US & Canada)": "America/Los_Angeles",
    "Brasilia": "America/Sao_Paulo",
    "Canberra, Melbourne, Sydney": "Australia/Sydney",
    "Chennai, Kolkata, Mumbai, New Delhi": "Asia/Kolkata",
    "Kathmandu": "Asia/Kathmandu",
    "Lord Howe Island": "Australia/Lord_Howe",
    "Newfoundland": "America/St_Johns",
    "Coordinated Universal Time": "UTC",
}
# Abbreviations, each of one offset (an abbreviation names an offset that doesn't change with the clocks).
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00",
    "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30", "NPT": "+05:45", "KST": "+09:00", "JST": "+09:00", "AEST": "+10:00",
    "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00", "BRT": "-03:00", "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00", "ADT": "-03:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}

#: An offset, alone or behind UTC or GMT: +0900, +09:00, UTC+9, GMT-8, (UTC+01:00). Minutes beyond 59 are no offset.
OFFSET = r"^\(?(?:utc|gmt)?\s*([+-])(\d{1,2})(?::?([0-5]\d))?\)?$"
DISPLAY = r"^\((?:utc|gmt)(?:[+-]\d{1,2}:\d{2})?\)\s*(\S.*)$"


def zone_names(spark: SparkSession) -> DataFrame:
    """(zone_key, zone): every name that this engine reads as a zone, in lower case. About 700 rows, whatever the data: fit to broadcast."""
    names = {k.lower(): k for k in zoneinfo.available_timezones() if k not in ("localtime", "Factory", "posixrules")}
    names |= {k.lower(): k for k in ("EST5EDT", "CST6CDT", "MST7MDT", "PST8PDT", "ROK", "GB", "Japan")}
    names |= {k.lower(): v for k, v in DISPLAY_CITIES.items()}
    names |= {k.lower(): v for k, v in SYSTEM_NAMES.items()}
    names |= {k.lower(): v for k, v in ABBREVIATIONS.items()}
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]").split(", "))  # the engine may know fewer zones than Python
    names = {k: v for k, v in names.items() if v in known or v[0] in "+-"}
    return spark.createDataFrame(sorted(names.items()), "zone_key string, zone string")


def clean_zone(text: Column) -> Column:
    """The spelling under which ``zone_names`` or ``OFFSET`` knows a zone: lower case, single blanks, without a display name's offset."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.regexp_replace(plain, DISPLAY, "$1")


def fixed_offset(zone_key: Column) -> Column:
    """``+hh:mm`` of a spelt-out offset up to 18 hours, else null. The sign is east positive, as people write it."""
    hours = F.regexp_extract(zone_key, OFFSET, 2)
    found = F.concat(F.regexp_extract(zone_key, OFFSET, 1), F.lpad(hours, 2, "0"), F.lit(":"), F.rpad(F.regexp_extract(zone_key, OFFSET, 3), 2, "0"))
    return F.when(zone_key.rlike(OFFSET) & (hours.try_cast("int") <= 14), found)


def resolved(local_us: Column, zone: Column) -> Column:
    """(us, shown) of a local time in a zone: microseconds UTC if it occurs there exactly once, and how often it occurs (0, 1 or 2).

    The zone's offsets a day before and a day after are the two that can hold. Each gives a candidate; a candidate counts if it
    is shown as the local time in question. None does in a gap, two different ones do in an overlap.
    """
    day = 86_400_000_000

    def shown(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))

    before, after = local_us - (shown(local_us - day) - (local_us - day)), local_us - (shown(local_us + day) - (local_us + day))
    at_before, at_after = shown(before) == local_us, shown(after) == local_us
    times = F.when(before == after, 1).otherwise(at_before.cast("int") + at_after.cast("int"))
    us = F.when(before == after, before).when(at_before & at_after, F.lit(None)).when(at_before, before).when(at_after, after)
    return F.when(local_us.isNotNull() & zone.isNotNull(), F.struct(us.alias("us"), times.alias("shown")))
