"""Event-log categories as one table of rules: a rule is data, and all categories come out of one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.texts import within


@dataclass(frozen=True)
class Category:
    """Events of ``ids`` in a channel whose name holds one of ``channels`` (any, if there are none); ``fields`` are labels to read from the XML."""

    name: str
    ids: tuple[int, ...]
    channels: tuple[str, ...]
    fields: tuple[str, ...] = ()


# Event ids, channels and the fields that their texts hold.
CATEGORIES = (
    Category("account_changed", (4720, 4723, 4726, 4738), (), ("TargetUserName", "SubjectUserName")),
    Category("antiforensics", (1100, 1102, 104), ("System", "Security")),
    Category("applications", (17,), ("Program-Compatibility",), ("ExePath", "ResolverName")),
    Category("dns", (1001, 3006, 3008, 3010, 3019, 3020), ("DNS",)),
    Category("file_handling", (4663,), ("Security",), ("SubjectUserName", "ObjectName")),
    Category("logonoff", (4624, 4634, 4625, 4648, 7002, 1, 2, 3, 4), ("Security", "User Profile Service"), ("TargetUserName",)),
    Category("ms_alerts", (300,), ("OAlerts",)),
    Category("msi_installer", (1033, 11707, 11724), ()),
    Category("network", (10000, 10001), ("NetworkProfile",), ("Name", "Description", "State", "Category")),
    Category("others", (7000, 6, 19, 7045), ("System",), ("DeviceName", "updateTitle", "Param1", "ServiceName")),
    Category("pc_onoff", (6005, 6006), ("System",)),
    Category("printer", (307, 801, 802), ("PrintService",)),
    Category("process", (4688, 4689), ("Security",), ("NewProcessName", "ProcessName")),
    Category("registry_handling", (4657,), ("Security",), ("SubjectUserName", "ObjectName", "ObjectValueName", "OldValue", "NewValue")),
    Category("remote_onoff", (24, 25, 42, 261, 1149, 41, 1024, 1102, 1027, 1105, 1026, 4689), ("TerminalServices-LocalSession", "TerminalServices-RemoteConnection", "TerminalServices-RDPClient"), ("User", "Address")),
    Category("screen_saver", (4802,), ("Security",)),
    Category("shared_folder", (4656, 4663, 5140, 30804, 30805, 30806, 30807, 30808), ("Security", "SMBClient")),
    Category("sleep_onoff", (107, 42, 1), ("System",), ("SleepTime", "WakeTime")),
    Category("task_scheduler", (200, 201), ("TaskScheduler",), ("ActionName",)),
    Category("telemetry", (500, 505), ("Telemetry",), ("FixName", "ExePath")),
    Category("time_changed", (4616, 1, 20000, 20001), ("Security", "DateTimeControlPanel"), ("PreviousTime", "NewTime")),
    Category("usb_devices", (1006, 507, 10000, 20001, 20003), ("Partition", "Storage", "System", "DriverFrameworks"), ("Manufacturer", "Model", "Revision", "SerialNumber", "ParentId")),
)
# What single events of a category mean.
DESCRIPTIONS = {
    ("logonoff", 4624): "Log On", ("logonoff", 4634): "Log Off", ("logonoff", 4625): "Log On Failed", ("logonoff", 4648): "Log On With Credentials",
    ("pc_onoff", 6005): "PC On", ("pc_onoff", 6006): "PC Off", ("sleep_onoff", 42): "Sleep", ("sleep_onoff", 107): "Wake", ("sleep_onoff", 1): "Sleep And Wake",
    ("account_changed", 4720): "Account Created", ("account_changed", 4723): "Password Changed", ("account_changed", 4726): "Account Deleted", ("account_changed", 4738): "Account Changed",
    ("antiforensics", 104): "Log Cleared", ("antiforensics", 1102): "Log Cleared", ("antiforensics", 1100): "Log Service Stopped",
    ("process", 4688): "Process Started", ("process", 4689): "Process Ended", ("time_changed", 4616): "Time Changed", ("printer", 307): "Document Printed",
    ("task_scheduler", 200): "Task Started", ("task_scheduler", 201): "Task Ended", ("usb_devices", 1006): "USB Connected", ("others", 7045): "Service Installed",
    ("screen_saver", 4802): "Screen Saver On", ("network", 10000): "Network Connected", ("network", 10001): "Network Disconnected",
}


def rule_table(spark: SparkSession) -> DataFrame:
    """(event_id, category, channels, description, fields): one row for each id of each category; under 200 rows, whatever the data."""
    rows = [(str(i), c.name, [ch.lower() for ch in c.channels], DESCRIPTIONS.get((c.name, i), c.name), list(c.fields)) for c in CATEGORIES for i in c.ids]
    return spark.createDataFrame(rows, "event_id string, category string, channels array<string>, description string, fields array<string>")


def categorised(events: DataFrame, event_id: str = "event_id", source: str = "source", data: str = "data") -> DataFrame:
    """``events`` with category, description and a map of the fields found. An event may belong to several categories; to each only once.

    A field that is missing is not in the map. Channels are compared regardless of case; an event with a null channel belongs to categories of
    any channel only. The rules of a category and id are one row with all its channels, so no event is hit twice and nothing is shuffled.
    """
    rules = F.broadcast(rule_table(events.sparkSession).select(F.col("event_id").alias("_id"), "category", F.col("channels").alias("_channels"), "description", F.col("fields").alias("_fields")))
    of_channel = (F.size("_channels") == 0) | F.coalesce(F.exists("_channels", lambda c: F.lower(F.col(source)).contains(c)), F.lit(False))
    hit = events.join(rules, (F.col(event_id).cast("string") == F.col("_id")) & of_channel)
    labels = sorted({f for c in CATEGORIES for f in c.fields})
    found = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("k"), F.when(F.array_contains("_fields", f), within(F.col(data), f)).alias("v")) for f in labels)), lambda x: x["v"].isNotNull()))
    return hit.select(*events.columns, "category", "description", found.alias("values"))


def described(kind: Column, rules: dict[str, str]) -> Column:
    """A kind's description by a small dictionary, null for others."""
    out = F.lit(None).cast("string")
    for k, v in rules.items():
        out = F.when(kind == k, v).otherwise(out)
    return out
