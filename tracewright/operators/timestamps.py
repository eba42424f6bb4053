"""Mixed timestamp texts to instants.

An ordered cascade of anchored patterns rewrites each value to one canonical record, ``year|month|day|hour|minute|second|fraction|
half|zone``; the first pattern that matches decides, and nothing is read that doesn't match one from end to end. Calendar fields are then
checked strictly. Counts carry their own epoch and unit. The zone comes from the value, else from the evidence. Local times that
their zone shows twice (clocks set back) or never (clocks set forward) give no instant: ``status`` says which. All of it is built-in
expressions in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.zones import clean_zone, fixed_offset, resolved, zone_names
from tracewright.session import BROADCAST_ROWS, lookup, spread

SECOND = 1_000_000
#: Microseconds from 1601-01-01 to 1970-01-01.
SINCE_1601 = 11_644_473_600 * SECOND

_DATE = r"(\d{4})-(\d{2})-(\d{2})"
_TIME = r"(\d{2}):(\d{2}):(\d{2})"
_ZONE = r"(?:\s*([Zz]|[+-]\d{2}:?\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)|\s+([A-Za-z][A-Za-z0-9_/+-]*))?"


@dataclass(frozen=True)
class Format:
    """A pattern for the whole value and the canonical record in terms of its groups."""

    name: str
    pattern: str
    record: str


FORMATS = (
    Format("iso", rf"^{_DATE}[Tt ]{_TIME}(?:[.,](\d{{1,9}}))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8$9"),
    Format("iso_region", rf"^{_DATE}[Tt ]{_TIME}(?:[.,](\d{{1,9}}))?\s*([Zz]|[+-]\d{{2}}:?\d{{2}})\[[A-Za-z0-9_/+-]+\]$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Format("region", rf"^{_DATE}[Tt ]{_TIME}(?:[.,](\d{{1,9}}))?\[([A-Za-z0-9_/+-]+)\]$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    Format("iso_minute", rf"^{_DATE}[Tt ](\d{{2}}):(\d{{2}}){_ZONE}$", "$1|$2|$3|$4|$5|00|||$6$7"),
    Format("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}}){_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7$8"),
    Format("digits", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6|||"),
    Format("month_first", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}})(?: ([AaPp][Mm]))?{_ZONE}$", "$3|$1|$2|$4|$5|$6||$7|$8$9"),
    Format("day_first", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8$9"),
    Format("slashed", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_TIME}(?:[.,](\d{{1,9}}))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8$9"),
    Format("mail", rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|||$7$8"),
)
# Months as mails write them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: App exports put the column's name and format in brackets behind a value.
ANNOTATION = r"\s*\([A-Za-z0-9_]+:[A-Za-z0-9_]+\)$"


def whole_div(value: Column, by: int) -> Column:
    """A digit text divided by a power of ten, without the rounding that doubles bring: the last digits are cut off."""
    return F.substring(value, 1, F.length(value) - F.lit(len(str(by)) - 1)).try_cast("bigint")


def count_micros(value: Column) -> Column:
    """Microseconds UTC of a bare count; its number of digits tells epoch and unit.

    10 seconds (also with a fraction), 13 milliseconds, 16 microseconds and 19 nanoseconds since 1970; 17 microseconds and 18 units of
    100 nanoseconds since 1601. Finer digits are dropped. Other lengths are no count.
    """
    whole, n = value.try_cast("bigint"), F.length(value)
    plain = value.rlike(r"^\d+$")
    fraction = F.rpad(F.substring(F.regexp_extract(value, r"^\d{10}\.(\d{1,9})$", 1), 1, 6), 6, "0").try_cast("bigint")
    return (
        F.when(plain & (n == 13), whole * 1000)
        .when(plain & (n == 17), whole - SINCE_1601)
        .when(plain & (n == 10), whole * SECOND)
        .when(plain & (n == 16), whole)
        .when(plain & (n == 19), whole_div(value, 1000))
        .when(plain & (n == 18), whole_div(value, 10) - SINCE_1601)
        .when(value.rlike(r"^\d{10}\.\d{1,9}$"), F.substring(value, 1, 10).try_cast("bigint") * SECOND + fraction)
    )


def record_of(value: Column) -> Column:
    """The canonical record of the first format that matches, else null."""
    chosen = None
    for f in FORMATS:
        rewritten = F.regexp_replace(value, f.pattern, f.record)
        chosen = F.when(value.rlike(f.pattern), rewritten) if chosen is None else chosen.when(value.rlike(f.pattern), rewritten)
    return chosen


def local_micros(part: Column) -> Column:
    """Microseconds of the canonical record's calendar fields as if they were UTC; null for impossible dates and times."""
    month = F.coalesce(
        part[1].try_cast("int"), F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(part[1])).try_cast("int"),
    )
    date = F.concat_ws("-", part[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(part[2], 2, "0")).try_cast("date")
    shown, half = part[3].try_cast("int"), F.lower(part[7])
    hour = (
        F.when(half == "", F.when(shown <= 23, shown))
        .when((shown < 1) | (shown > 12), F.lit(None))
        .otherwise(F.pmod(shown, F.lit(12)) + F.when(half == "pm", 12).otherwise(0))
    )
    minute, second = (F.when(part[i].try_cast("int") <= 59, part[i].try_cast("int")) for i in (4, 5))
    fraction = F.rpad(F.substring(part[6], 1, 6), 6, "0").try_cast("bigint")
    days = F.when(part[0] != "0000", F.unix_date(date)).cast("bigint")
    return (days * 86_400 + hour * 3_600 + minute * 60 + second) * SECOND + fraction


def normalise_timestamps(frame: DataFrame, evidence: DataFrame, value: str = "timestamp", key: str = "evd_id", row: str = "row_id", broadcast_rows: int = BROADCAST_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, row, utc_us, status) of every row of ``frame``.

    ``evidence`` has ``key`` and ``timezone``; a key is matched as it is spelt, and of several rows of a key the greatest zone text counts.
    status: ``ok``; ``empty`` (null, blank, zero or an epoch's midnight); ``unreadable`` (no pattern, or no such date); ``no_zone``;
    ``ambiguous`` (the zone shows the local time twice); ``nonexistent`` (it skips it). Null keys, repeated rows and an empty table are fine;
    other columns of ``frame`` than the named ones aren't read, so none can clash.
    """
    spark = frame.sparkSession
    text = F.regexp_replace(F.trim(F.regexp_replace("_value", r"^\s+|\s+$", "")), ANNOTATION, "")
    kept = [f"_kept{i}" for i in range(len(keep))]
    facts = spread(frame.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.col(value).alias("_value"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True))))
    facts = facts.select("_row", "_key", *kept, text.alias("_text"))
    facts = facts.withColumn("_count", count_micros(F.col("_text")))
    facts = facts.withColumn("_part", F.when(F.col("_count").isNull(), F.split(record_of(F.col("_text")), r"\|")))
    facts = facts.select("*", F.nullif(F.col("_part")[8], F.lit("")).alias("_own"))
    facts = facts.withColumn("_local", F.when(F.col("_part").isNotNull(), local_micros(F.col("_part"))))
    zones = evidence.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_ask")).agg(F.max("timezone").alias("_theirs"))
    # Only local times without a zone of their own ask the evidence; the other rows have a null key and match nothing.
    facts = facts.withColumn("_ask", F.when(F.col("_local").isNotNull() & F.col("_own").isNull(), F.col("_key")))
    joined = lookup(facts, zones, "_ask", "_row", rows=broadcast_rows)
    joined = joined.withColumn("zone_key", clean_zone(F.coalesce("_own", "_theirs")))
    joined = joined.join(F.broadcast(zone_names(spark)), "zone_key", "left")
    joined = joined.withColumn("_zone", F.coalesce(fixed_offset(F.col("zone_key")), F.col("zone")))
    joined = joined.withColumn("_found", resolved(F.col("_local"), F.col("_zone")))
    joined = joined.withColumn("_utc", F.coalesce("_count", "_found.us"))
    epochs = (0, -SINCE_1601)
    blank = F.coalesce(F.col("_text"), F.lit("")).isin("", "0") | F.col("_utc").isin(*epochs) | F.col("_local").isin(*epochs)
    status = (
        F.when(blank, "empty")
        .when(F.col("_utc").isNotNull(), "ok")
        .when(F.col("_local").isNull(), "unreadable")
        .when(F.col("_zone").isNull(), "no_zone")
        .when(F.col("_found.shown") == 0, "nonexistent")
        .otherwise("ambiguous")
    )
    joined = joined.withColumn("status", status)
    return joined.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("_row").alias(row), F.when(F.col("status") == "ok", F.col("_utc")).alias("utc_us"), "status")
