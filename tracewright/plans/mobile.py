"""Calls and messages of phones, and the rules that assign files to apps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import bits
from tracewright.operators.joins import first_by_role, first_match, flagged, with_default


def calls(frame: DataFrame) -> DataFrame:
    """(number, kind, at, seconds)."""
    return frame.select("number", bits.decoded(F.col("type").cast("bigint"), bits.CALL_TYPES).alias("kind"), F.timestamp_millis(F.col("date")).alias("at"), F.col("duration").cast("bigint").alias("seconds"))


def sms(frame: DataFrame) -> DataFrame:
    """(address, box, at, body); a date of 0 is none."""
    at = F.when(F.col("date") != 0, F.timestamp_millis(F.col("date")))
    return frame.select("address", bits.decoded(F.col("type").cast("bigint"), bits.MESSAGE_BOXES).alias("box"), at.alias("at"), "body")


def mms(messages: DataFrame, addresses: DataFrame, parts: DataFrame) -> DataFrame:
    """(_id, from, to, cc, bcc, at, text): of several addresses of a role the first counts; messages without a part keep a null text."""
    roles = first_by_role(addresses.select("msg_id", F.col("type").cast("bigint").alias("type"), "address", "_id"), "msg_id", "type", "address", F.col("_id"), bits.ADDRESS_ROLES)
    body = parts.filter("ct = 'text/plain'").select(F.col("mid").alias("_id"), "text")
    joined = messages.join(roles.withColumnRenamed("msg_id", "_id"), "_id", "left").join(body, "_id", "left")
    return joined.select("_id", "from", "to", "cc", "bcc", F.timestamp_seconds("date").alias("at"), "text")


def contacts(messages: DataFrame, people: DataFrame) -> DataFrame:
    """``messages`` with the sender's name; an unknown sender keeps an empty one."""
    return with_default(messages, people.select(F.col("id").alias("sender"), "name"), "sender", {"name": F.lit("")})


def files_of_apps(files: DataFrame, apps: DataFrame) -> DataFrame:
    """``files`` with the app whose folder they lie in. Apps are tried in the order of ``uid``, each with its folders of data, storage and code in turn.

    ``apps`` has (uid, package); a folder that two apps claim belongs to the earlier one.
    """
    roots = ("/data/data/", "/data/user/0/", "/sdcard/Android/data/", "/data/app/")
    patterns = apps.select("package", F.posexplode(F.array(*(F.concat(F.lit(r), "package", F.lit("/")) for r in roots))).alias("k", "prefix"), "uid")
    ranked = patterns.select("prefix", "package", F.struct("uid", "k").alias("rank"))
    return first_match(files, "path", ranked, "prefix", "rank", "row_id", (4, 5))


def known_files(files: DataFrame, digests: DataFrame) -> DataFrame:
    """``files`` with whether their SHA-1 is in a set of known ones, in whatever case it is written."""
    return flagged(files, F.upper("sha1"), digests, F.upper("digest"), "known")
