"""Whole analyses over decoded artifact tables: timeline, communication, execution and file histories, journal merge, usage.

Each takes DataFrames by name and gives one; a table that is missing counts as empty. Results are declared with explicit schemas so that
they can be appended to tables. Deviations from what scripts of this kind do are on purpose: times stay UTC, spellings of labels are right,
and words like ``Sent`` are compared regardless of case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import bits, texts, times
from tracewright.operators import joins as J
from tracewright.operators import reshape as R
from tracewright.plans.registry import ANALYSES

TAGS = ["par_id", "case_id", "evd_id"]


def _told(frame: DataFrame, **fields: str) -> Column:
    """``label:value`` of each field, joined with commas; what is missing is empty."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{label}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in fields.items() if c in frame.columns))


def _seconds_between(start: str, end: str) -> Column:
    """The duration text between two time texts; none if the end is blank or unreadable."""
    seconds = F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(F.try_to_timestamp(start))
    return F.coalesce(times.duration_text(seconds), F.lit("00:00:00"))


#: The sources of the timeline: table, kind, column of the time, duration (None for none), labelled fields. Browsers keep downloads alike.
BROWSERS = {"chrome": "Chrome", "edge": "Chromium Edge", "firefox": "Firefox", "opera": "Opera", "whale": "Whale"}
TIMELINE = (
    ("calls", "Call", "date", lambda: times.duration_text(F.col("duration").try_cast("bigint")), {"from": "sender", "to": "number", "call_type": "type"}),
    ("mms", "Message(MMS)", "date", None, {"from": "sender", "to": "address", "content": "body"}),
    ("sms", "Message(SMS)", "date", None, {"from": "_from", "to": "_to", "content": "body"}),
    ("app_usage", "Android App", "last_time", lambda: times.duration_text(F.floor(F.col("active_ms").try_cast("bigint") / 1000)), {"package": "package", "source": "origin"}),
    *((f"downloads_{key}", "Web Download", "start_time", lambda: _seconds_between("start_time", "end_time"), {"browser": "_browser", "source": "url", "file_path": "path", "os_account": "account", "profile": "profile"}) for key in BROWSERS),
    ("usb", "USB Connection", "last_connected", None, {"source": "origin", "friendly_name": "name", "serial_number": "serial", "device_description": "description", "drive_letter": "drive"}),
    ("usb_events", "USB Connection", "time", None, {"manufacturer": "manufacturer", "model": "model", "serial_number": "serial", "event_id": "event_id", "event_id_description": "description", "source": "origin"}),
)


def timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """(tags, event_type, event_time, duration, description) of eleven sources: calls, MMS, SMS, app use, downloads of five browsers, and USB
    connections by the registry and by the event log. Sources that are missing count as empty; fields that a table lacks aren't told."""
    parts = []
    for name, kind, when, duration, fields in TIMELINE:
        if name not in tables:
            continue
        t = tables[name]
        if name == "sms":
            sent = F.coalesce(F.lower("direction") == "sent", F.lit(False))
            t = t.withColumn("_from", F.when(~sent, F.col("address"))).withColumn("_to", F.when(sent, F.col("address")))
        if name.startswith("downloads_"):
            t = t.withColumn("_browser", F.lit(BROWSERS[name.removeprefix("downloads_")]))
        shown = duration() if duration else F.lit("00:00:00")
        parts.append(t.select(*TAGS, F.lit(kind).alias("event_type"), F.col(when).cast("string").alias("event_time"), shown.alias("duration"), _told(t, **fields).alias("description")))
    return R.union_of(parts)


def communication(tables: dict[str, DataFrame]) -> DataFrame:
    """(tags, kind, direction, partner, at, message) of chats, messages and calls; only characters 3 to 5 of a message are shown."""
    parts = []

    def part(frame, kind, direction, partner, when, text):
        return frame.select(*TAGS, F.lit(kind).alias("kind"), direction.alias("direction"), partner.alias("partner"), F.concat(when, F.lit("Z")).alias("at"), texts.masked(text, 3, 3).alias("message"))

    if {"chats", "friends", "rooms"} <= tables.keys():
        friends, rooms = tables["friends"].select("friend_id", "phone", "name"), tables["rooms"].select("room_id", F.col("title"))
        joined = tables["chats"].join(friends, "friend_id").join(rooms, "room_id")
        parts.append(part(joined, "Chat", F.when(F.coalesce("phone", F.lit("")) == "", "Outgoing").otherwise("Incoming"), F.coalesce("name", "title"), F.col("date"), F.col("message")))
    if "sms" in tables:
        parts.append(part(tables["sms"], "SMS", F.when(F.lower("direction") == "sent", "Outgoing").otherwise("Incoming"), F.col("address"), F.col("date"), F.col("body")))
    if "mms" in tables:
        parts.append(part(tables["mms"], "MMS", F.when(F.col("sender") == "insert-address-token", "Outgoing").otherwise("Incoming"), F.col("address"), F.col("date"), F.col("body")))
    if "calls" in tables:
        parts.append(part(tables["calls"], "Call", F.col("type"), F.col("number"), F.col("date"), F.lit("")))
    return R.union_of(parts)


def app_history(tables: dict[str, DataFrame]) -> DataFrame:
    """(tags, process_name, execution_time, process_path, source) of executions from several traces; prefetch gives up to nine each."""
    parts = []
    for name, path, when, label in (("user_assist", "file_name", "last_run_time", "UserAssist"), ("amcache", "path", "modified", "Amcache"), ("activities", "path", "start_time", "Timeline"), ("event_applications", "path", "time", "EventLog - Application"), ("jump_lists", "path", "time", "Jump List")):
        if name in tables:
            t = tables[name].filter(times.after_epoch(F.col(when)))
            parts.append(t.select(*TAGS, texts.base_name(F.col(path)).alias("process_name"), F.col(when).alias("execution_time"), F.col(path).alias("process_path"), F.lit(label).alias("source")))
    if "prefetch" in tables:
        p = tables["prefetch"].select("*", *R.list_columns(F.col("run_times"), ",", 8, "run"))
        runs = R.labelled_times(p, [*TAGS, "name", "path"], {"created": F.col("created"), **{f"run{i}": F.col(f"run{i}") for i in range(1, 9)}}, "event", "execution_time")
        parts.append(runs.select(*TAGS, F.col("name").alias("process_name"), "execution_time", F.col("path").alias("process_path"), F.lit("Prefetch").alias("source")))
    return R.union_of(parts)


def file_history(files: DataFrame) -> DataFrame:
    """Files that are no slack space, with ISO times and is_copied ('Y' if modified before created). Rows of unknown type are left out as well."""
    kept = files.filter(F.col("type") != 7)
    copied = bits.earlier(F.col("mtime"), F.col("mtime_nano"), F.col("ctime"), F.col("ctime_nano"))

    def shown(c: str) -> Column:
        seconds = times.epoch_switched(F.col(c), F.col("mtime"), F.col("ctime"))
        return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.col(f"{c}_nano").cast("string"), F.lit("Z")).alias(f"{c}_text")

    return kept.select("*", F.when(copied, "Y").otherwise("N").alias("is_copied"), *(shown(c) for c in ("mtime", "ctime")))


def journal_history(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Full outer join of file records and journal changes by reference.

    reason: FILE_DELETE if it is among the words; '' if the last is CLOSE; else the first. Matched rows with '' are left out, changes alone keep it.
    A record alone is one MFT_FILE_CREATE.
    """
    words = F.split(F.trim("reason"), r"\s+")
    short = F.when(F.array_contains(words, "FILE_DELETE"), "FILE_DELETE").when(F.element_at(words, -1) == "CLOSE", "").otherwise(words[0])
    both = J.both_sides(records, changes.withColumn("change", short).drop("reason"), "reference")
    change = F.when(F.col("side") == "left", "MFT_FILE_CREATE").otherwise(F.col("change"))
    size = F.when(F.col("side") == "right", "?").otherwise(F.col("size").cast("string"))
    out = both.withColumn("change", change).withColumn("size", size)
    return out.filter((F.col("side") != "both") | (F.col("change") != ""))


#: The times of a USB device that the registry keeps, and what they are called.
USB_TIMES = {
    "last_connected": "USB Last Connected", "first_connected": "USB First Connected", "first_since_reboot": "USB First Connected Since Reboot", "driver_installed": "USB Driver Installed",
    "first_installed": "USB First Installed", "last_insertion": "USB Last Insertion", "last_removal": "USB Last Removal",
}
#: Tasks of event logs that count as use.
TASKS = {"LogOn - Success": "Log On", "LogOff": "Log Off", "System On": "System On", "System Off": "System Off", "Connected": "USB Connected", "Disconnected": "USB Disconnected"}
#: Files that programs bring as templates.
TEMPLATES = ("document.doc", "hancom.hwp")


def usage_detail(tables: dict[str, DataFrame]) -> DataFrame:
    """(regdate, evdnc_type, artifact_type, information, case_id, evd_id) of thirteen sources.

    documents (created always, modified only if later), links (twice), logons, power, sleep (start and end), usb_events, usb (seven times),
    ie_downloads, ie_history, downloads, search_terms, visits and app_history (prefetch only). Times that say nothing give no row.
    """
    parts = []

    def part(frame: DataFrame, events: dict[str, tuple[Column, Column]], kind: Column, text: Column) -> None:
        rows = R.emitted(frame.select("case_id", "evd_id", kind.alias("_kind"), text.alias("_text"), *(c.cast("string").alias(f"_t{i}") for i, (_, c) in enumerate(events.values())), *(c.alias(f"_c{i}") for i, (c, _) in enumerate(events.values()))),
                         ["case_id", "evd_id", "_kind", "_text"], {name: (F.col(f"_c{i}"), F.col(f"_t{i}")) for i, name in enumerate(events)}, "_event", "_at")
        parts.append(rows.select(F.col("_at").alias("regdate"), F.col("_event").alias("evdnc_type"), F.col("_kind").alias("artifact_type"), F.col("_text").alias("information"), "case_id", "evd_id"))

    yes, log, web = F.lit(True), F.lit("EventLog"), F.lit("Web Artifact")
    joined = lambda frame, *columns, mark="|": F.concat_ws(mark, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in frame.columns))
    if "documents" in tables:
        like = [texts.like_ci(F.col("extension"), p) for p in ("doc%", "xls%", "ppt%", "hwp%", "pdf%")]
        d = tables["documents"].filter(like[0] | like[1] | like[2] | like[3] | like[4]).filter(~F.lower("name").isin(*TEMPLATES))
        part(d, {"Created Time": (yes, F.col("created")), "Modified Time": (F.col("modified") > F.col("created"), F.col("modified"))}, F.lit("File Info"), F.col("name"))
    if "links" in tables:
        t = tables["links"]
        part(t, {"File/Folder Open": (yes, F.col("created"))}, F.lit("Link"), F.col("path"))
        part(t, {"File/Folder Open": (yes, F.col("written"))}, F.lit("Link"), F.col("path"))
    for name in ("logons", "power", "usb_events"):
        if name in tables:
            t = tables[name]
            text = joined(t, "device", "description", "manufacturer", "model", "revision", "serial", "user") if name == "usb_events" else F.col("description")
            part(t, {label: (F.col("task") == task, F.col("time")) for task, label in TASKS.items()}, log, text)
    if "sleep" in tables:
        part(tables["sleep"], {"Sleep Start": (yes, F.col("slept")), "Sleep End": (yes, F.col("woke"))}, log, F.col("description"))
    if "usb" in tables:
        t = tables["usb"]
        part(t, {label: (yes, F.col(c)) for c, label in USB_TIMES.items() if c in t.columns}, F.lit("Registry"), joined(t, "device", "description", "name", "serial", "volume", "drive", "user"))
    for name, label, when, columns, mark in (
        ("ie_downloads", "IE Accessed Time - Download", "modified", ("url",), "|"), ("ie_history", "IE Accessed Time - History", "modified", ("url",), "|"),
        ("downloads", "Chrome Started Time - Download", "start_time", ("name", "url"), " | "), ("search_terms", "Chrome Updated Time - Search Term", "searched", ("term",), "|"),
        ("visits", "Chrome Accessed Time - Visit URL", "visited", ("title", "url"), "|"),
    ):
        if name in tables:
            t = tables[name]
            t = t.withColumn("url", F.translate("url", "\\", "/")) if "url" in t.columns else t
            part(t, {label: (yes, F.col(when))}, web, joined(t, *columns, mark=mark))
    if "app_history" in tables:
        t = tables["app_history"].filter("source = 'Prefetch'")
        part(t, {"Application Execution Time": (yes, F.col("execution_time"))}, F.col("source"), F.col("process_name"))
    return R.union_of(parts).filter((F.trim("regdate") != "") & ~F.col("regdate").startswith("1601-01"))


def document_marks(documents: DataFrame, zones: DataFrame) -> DataFrame:
    """``documents`` with 0/1 marks: is_downloaded (its path has a zone stream), is_copied (modified before created) and is_created (born inside)."""
    marked = J.flagged(documents, F.col("path"), zones, F.col("path"), "is_downloaded", 1, 0)
    return marked.withColumn("is_copied", F.coalesce((F.col("mtime") < F.col("ctime")).cast("int"), F.lit(0))).withColumn("is_created", F.coalesce((F.col("inner_created") > F.col("ctime")).cast("int"), F.lit(0)))


def usb_devices(stores: DataFrame, volumes: DataFrame, mounted: DataFrame, drives: DataFrame) -> DataFrame:
    """(serial, device, volume, drive, label): what the keys of a registry tell about each USB store.

    ``stores`` has (serial, device); ``volumes`` (key) names the volumes of stores, with the serial between ``#`` marks; ``mounted`` (name, data) maps drive
    letters and volume ids to texts that hold the serial; ``drives`` (key) has serial and label as ``serial#label_number``. Serials are cut out of
    the texts, so all joins are equi joins; of several matches the first in the order of the texts counts, what is missing is null.
    """
    inside = lambda c: F.upper(F.regexp_extract(c, r"#([^#&]+)(?:&\d+)?#\{", 1))
    s = stores.select(F.upper(F.regexp_replace("serial", r"&\d+$", "")).alias("serial"), "device")
    v = volumes.select(inside(F.col("key")).alias("serial"), F.col("key").alias("volume")).filter("serial <> ''").groupBy("serial").agg(F.min("volume").alias("volume"))
    m = mounted.select(inside(F.col("data")).alias("serial"), F.regexp_extract("name", r"([A-Z]:)$", 1).alias("drive")).filter("serial <> '' and drive <> ''").groupBy("serial").agg(F.min("drive").alias("drive"))
    d = drives.select(F.upper(F.substring_index("key", "#", 1)).alias("serial"), F.regexp_extract("key", r"#(.*)_\d+$", 1).alias("label")).groupBy("serial").agg(F.min("label").alias("label"))
    return s.join(v, "serial", "left").join(m, "serial", "left").join(d, "serial", "left").select("serial", "device", "volume", "drive", "label")


def registry_columns(values: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row a key with a column for each of ``names``; of repeated values the greatest counts."""
    return values.groupBy(key).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


for _f in (timeline, communication, app_history, file_history, journal_history, usage_detail):
    ANALYSES.add(_f.__name__, _f)
