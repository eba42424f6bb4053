"""Scalar functions, detectors, decoders and classifier figures bound to the driver's tables, and the same in SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import bits, texts, times
from tracewright.functions.detectors import semantic_type
from tracewright.operators import aggregates as A
from tracewright.operators import reshape as R
from tracewright.operators import windows as W
from tracewright.plans import classifier
from tracewright.plans.registering import Queries
from tracewright.plans.registry import ANALYSES, Registry, fitting_plugins
from tracewright.session import table
from tracewright.sources import files, hives, records, sinks

CASES = Queries()
query = CASES.query


def _shown(column, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    return F.date_format(column, pattern)


def shown_sql(micros: str, pattern: str = "%Y-%m-%d %H:%M:%S.%f") -> str:
    return f"strftime(make_timestamp(({micros})::bigint), '{pattern}')"


# ------------------------------------------------------------------ times


@query(f"select event_id, (13300000000 + event_id - 11644473600) * 1000000 + (event_id % 10000000) // 10 as us, {shown_sql('(13300000000 + event_id - 11644473600) * 1000000 + (event_id % 10000000) // 10')} as at from events")
def filetime_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since 1601 and a fraction in 100 ns."""
    us = times.unix_micros_of_filetime(F.col("event_id") + 13_300_000_000, F.col("event_id") % 10_000_000)
    return table(spark, d, "events").select("event_id", us.alias("us")).withColumn("at", _shown(F.timestamp_micros("us")))


@query(f"select row_id, case length(timestamp) when 13 then {shown_sql('try_cast(timestamp as bigint) * 1000')} when 16 then {shown_sql('try_cast(timestamp as bigint)')} end as at from call_history where regexp_full_match(timestamp, '[0-9]+')")
def unix_by_digits(spark: SparkSession, d: str) -> DataFrame:
    """13 digits are milliseconds, 16 microseconds, others nothing."""
    c = table(spark, d, "call_history").filter(F.col("timestamp").rlike(r"^\d+$"))
    return c.select("row_id", _shown(times.unix_by_length(F.col("timestamp"))).alias("at"))


@query("select event_id, strftime(make_timestamp((event_id * 86413 - 40000000) * 1000000), '%Y-%m-%dT%H:%M:%S') as at, case when event_id = 0 then '' else strftime(make_timestamp(event_id * 86413 * 1000), '%Y-%m-%d %H:%M:%S') end as text, strftime(make_timestamp(event_id * 86413 * 1000) + interval 9 hour, '%Y-%m-%d %H:%M:%S') as local from events")
def unix_texts(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to ISO text, milliseconds to a text by pattern (0 is empty) and to the local time of a zone."""
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", times.iso_of_seconds(e * 86413 - 40_000_000).alias("at"), times.millis_text(e * 86413, "%Y-%m-%d %H:%i:%s").alias("text"), times.millis_in_zone(e * 86413, "Asia/Seoul").alias("local"))


@query("select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate + to_seconds(o_custkey::double), '%Y-%m-%d %H:%M:%S') end as at from orders")
def mail_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as mails write them; what isn't one is null."""
    text = F.date_format(F.timestamp_add("SECOND", F.col("o_custkey").cast("int"), F.col("o_orderdate")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("t"))
    return o.select("o_orderkey", _shown(times.mail_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select event_id, case event_id % 4 when 0 then (1600000000 + event_id) * 1000000 + event_id * 7 % 1000000 when 1 then (13300000000 + event_id - 11644473600) * 1000000 + (event_id * 7 % 1000000) // 10 when 2 then (160000000000 + event_id) * 10000 end as us from events""")
def source_times(spark: SparkSession, d: str) -> DataFrame:
    """A file's time by the kind of file system that keeps it."""
    n = F.col("event_id")
    kind = F.when(n % 4 == 0, "tsk").when(n % 4 == 1, "ntfs").when(n % 4 == 2, "os")
    value = F.when(n % 4 == 0, n + 1_600_000_000).when(n % 4 == 1, n + 13_300_000_000).otherwise(n + 160_000_000_000)
    fraction = F.when(n % 4 == 0, n * 7 % 1_000_000 * 1000 + 999).otherwise(n * 7 % 1_000_000)
    return table(spark, d, "events").select("event_id", times.by_file_system(kind, value, fraction).alias("us"))


@query(f"select event_id, {shown_sql('(132000000000000000 + event_id * 123456789) // 10 - 11644473600000000')} as at from events")
def big_endian_times(spark: SparkSession, d: str) -> DataFrame:
    """Eight bytes, big endian, of 100 ns since 1601."""
    content = F.unhex(F.lpad(F.hex(F.col("event_id") * 123_456_789 + 132_000_000_000_000_000), 16, "0"))
    return table(spark, d, "events").select("event_id", _shown(times.filetime_of_bytes(content)).alias("at"))


# ------------------------------------------------------------------ texts and bits

_GUID = "md5(file_name)"


@query(f"""select row_id, {" || '-' || ".join("||".join(f"substring({_GUID}, {2 * i + 1}, 2)" for i in group) for group in ((3, 2, 1, 0), (5, 4), (7, 6), (8, 9), range(10, 16)))} as guid,
    {"||".join(f"substring({_GUID}, {2 * i + 1}, 2)" for i in reversed(range(16)))} as turned from lv1_os_win_reg_user_assist""")
def guid_texts(spark: SparkSession, d: str) -> DataFrame:
    """Hex digits of a GUID in memory order, and bytes turned round."""
    return table(spark, d, "lv1_os_win_reg_user_assist").select("row_id", texts.guid(F.md5("file_name")).alias("guid"), texts.reversed_bytes(F.md5("file_name")).alias("turned"))


@query("select event_id, event_id * 65537 as number, (event_id - 5000) & 4294967295 as high from events")
def little_endian_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in little-endian hex, and signed words as unsigned ones."""
    hexed = texts.reversed_bytes(F.lpad(F.hex(F.col("event_id") * 65537), 12, "0"))
    return table(spark, d, "events").select("event_id", texts.little_endian(hexed).alias("number"), bits.unsigned_high(F.col("event_id") - 5000).alias("high"))


@query("""select row_id, nullif(coalesce(account, ''), '') as user, lower(regexp_replace(coalesce(contents, ''), '["''\\[\\]()0-9]', '', 'g')) as bare, 'root' || source as rooted from call_history""")
def xml_fields(spark: SparkSession, d: str) -> DataFrame:
    """The text between a label and the last angle bracket of its line; bare words; paths under the root."""
    xml = F.concat(F.lit('<Data Name="SubjectUserName">x</Data>\n<Data Name="TargetUserName">'), F.coalesce("account", F.lit("")), F.lit("</Data>\n<b>"))
    return table(spark, d, "call_history").select("row_id", texts.within(xml, "TargetUserName").alias("user"), texts.bare_words(F.coalesce("contents", F.lit(""))).alias("bare"), texts.rooted(F.col("source")).alias("rooted"))


@query("select row_id, url as text from web_browser_history")
def xml_unescaped(spark: SparkSession, d: str) -> DataFrame:
    """XML entities as characters: what was escaped comes back as it was."""
    escaped = F.col("url")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(name))
    return table(spark, d, "web_browser_history").select("row_id", texts.unescaped(F.concat(escaped, F.lit("\0"))).alias("text"))


_FLAGS = {1: "READONLY", 2: "HIDDEN", 4: "SYSTEM", 16: "DIRECTORY", 32: "ARCHIVE"}


@query(f"select event_id, concat_ws('|', {', '.join(f'case when event_id & {k} <> 0 then {v!r} end' for k, v in _FLAGS.items())}) as flags from events")
def attribute_flags(spark: SparkSession, d: str) -> DataFrame:
    """Set bits by name."""
    return table(spark, d, "events").select("event_id", bits.flag_names(F.col("event_id"), _FLAGS).alias("flags"))


@query("select row_id, account from call_history where lower(account) = 'sim1' or account like 'user0%'")
def like_as_equality(spark: SparkSession, d: str) -> DataFrame:
    """LIKE without a wildcard is equality regardless of case."""
    c = table(spark, d, "call_history")
    return c.filter(texts.like_ci(F.col("account"), "SIM1") | texts.like_ci(F.col("account"), "USER0%")).select("row_id", "account")


_APPS = {"9b9cdc69c1c24e2b": "Notepad", "5f7b5f1e01b83767": "Quick Access", "1b4dd67f29cb1962": "Explorer"}


@query(f"""select event_id, case event_id % 4 {" ".join(f"when {i} then '{v}'" for i, v in enumerate(_APPS.values()))} end as app, case event_id % 20 when 2 then 'Notification' when 3 then 'Mobile Backup' when 5 then 'Open App/File/Page' when 6 then 'App In Use/Focus' when 10 then 'Clipboard'
    when 16 then 'Copy/Paste' when 11 then 'System' when 12 then 'System' when 15 then 'System' end as activity, case when event_id % 2 = 0 then 'second' else 'first' end as chosen, case when event_id % 3 = 0 then 'root/x/Chrome' else 'root/x/Chrome/p' || event_id end as origin from events""")
def activity_fields(spark: SparkSession, d: str) -> DataFrame:
    """Jump-list programs, kinds of activities, the application of an activity and where a browser's record comes from."""
    n = F.col("event_id")
    ids = F.element_at(F.array(*(F.lit(x) for x in (*_APPS, "0000"))), (n % 4 + 1).cast("int"))
    json = F.concat(F.lit('[{"application":"first","platform":"'), F.when(n % 2 == 0, "afs_crossplatform").otherwise("windows"), F.lit('"},{"application":"second","platform":"x"}]'))
    profile = F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("p"), n))
    return table(spark, d, "events").select("event_id", texts.app_name(F.concat(F.lit("C:\\Recent\\"), ids, F.lit(".automaticDestinations-ms")), _APPS).alias("app"), texts.activity_type(n % 20).alias("activity"), texts.activity_app(json).alias("chosen"), texts.provenance(F.lit("root/x"), "Chrome", profile).alias("origin"))


@query("select doc_id as note_id, title as content from documents union all select -row_id, regexp_replace(contents, '\\s', '', 'g') from geodata")
def sticky_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes and their media, of which white space is taken out."""
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), F.col("title").alias("content"))
    return R.notes_and_media(notes, table(spark, d, "geodata").select((-F.col("row_id")).alias("note_id"), F.col("contents").alias("content")))


@query("select o_orderkey, 300 + o_custkey % 7 as length1, o_orderkey + 200 as lcn1, 5::bigint as length2, o_orderkey + 100 as lcn2, 2 as n from orders")
def data_run_lists(spark: SparkSession, d: str) -> DataFrame:
    """Run lists in hex: lengths and offsets, which are relative to the run before and signed."""
    hexed = F.concat(F.lit("42"), _little(F.col("o_custkey") % 7 + 300, 2), _little(F.col("o_orderkey") + 200, 4), F.lit("1105"), F.lit("9C"), F.lit("00FFFF"))
    runs = table(spark, d, "orders").select("o_orderkey", W.data_runs(hexed).alias("r"))
    return runs.select("o_orderkey", *(F.col("r")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in ("length", "lcn")), F.size("r").alias("n"))


@query("select doc_id, 'file' as kind, '' as stream, n_chars as bytes from documents union all select doc_id, 'stream', k, (case k when 'Zone.Identifier' then 26 else n_chars end)::bigint from documents, (values ('Zone.Identifier'), ('thumb')) v(k) where doc_id % 3 = 0")
def stream_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files and a row for each of their named streams."""
    docs = table(spark, d, "documents")
    streams = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("Zone.Identifier").alias("name"), F.lit(26).cast("bigint").alias("size")), F.struct(F.lit("thumb").alias("name"), F.col("n_chars").alias("size"))))
    return R.with_streams(docs.withColumn("streams", streams), ["doc_id"], F.col("n_chars"), "streams")


@query("select event_id, case when event_type = 'error' then 'fault' else event_type end as event_type, case when user_id > 100 then -1 else value end as value from events")
def update_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Rows after an update of two columns."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    return sinks.updated(e, {"event_type": (F.col("event_type") == "error", F.lit("fault")), "value": (F.col("user_id") > 100, F.lit(-1.0))}).drop("user_id")


@query("select n_nationkey, n_name from nation")
def absent_table_is_empty(spark: SparkSession, d: str) -> DataFrame:
    """A table that the catalog lacks has no rows but a schema."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return n.unionByName(sinks.table_or_empty(spark, "no_such_table_of_nations", n.schema))


@query("select * from (values ('selected', 'app_history'), ('selected', 'timeline'), ('all', 'app_history'), ('all', 'communication'), ('all', 'file_history'), ('all', 'journal_history'), ('all', 'timeline'), ('all', 'usage_detail'), ('plugin', 'docx'), ('fitting', 'history')) v(how, name)")
def chosen_modules(spark: SparkSession, d: str) -> DataFrame:
    """What expressions select among the registered analyses, and the plugins whose tables are there."""
    rows = [("selected", n) for n in ANALYSES.selected("timeline,!communication,app_history")] + [("all", n) for n in ANALYSES.selected(None)] + [("plugin", n) for n in Registry.plugins("documents/docx,timeline", "documents")]
    rows += [("fitting", n) for n in fitting_plugins({"history": {"a", "b"}, "webcache": {"c"}}, {"a", "b", "x"})]
    return spark.createDataFrame(rows, "how string, name string")


@query("""with g as (select user_id, event_id % 4 as kind, list(event_id order by event_id) as ids from events group by 1, 2) select user_id, count(*) as kinds, string_agg(kind || ':' || array_to_string(ids, ','), ';' order by kind) as nested from g group by 1""")
def grouped_twice(spark: SparkSession, d: str) -> DataFrame:
    """Records under groups under groups."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("kind"), "event_id")
    nested = A.grouped_twice(e, "user_id", "kind", ["event_id"])
    shown = F.array_join(F.transform("groups", lambda g: F.concat(g["kind"], F.lit(":"), F.array_join(F.transform(g["records"], lambda r: r["event_id"].cast("string")), ","))), ";")
    return nested.select("user_id", F.size("groups").cast("bigint").alias("kinds"), shown.alias("nested"))


# ------------------------------------------------------------------ decoders over bytes and texts


def _files(frame: DataFrame, key: str, text) -> DataFrame:
    return frame.select(F.col(key).cast("string").alias("path"), text.cast("binary").alias("content"))


@query("select c_custkey::varchar as path, c_name || ' <a' || c_custkey || '@x.test>' as sender, 'to' || c_nationkey || '@y.test,b@y.test' as receivers, case when c_custkey % 2 = 0 then 'c@y.test' else '' end as cc, '' as bcc, c_mktsegment as subject, 'Tue, 05 Mar 2024 10:11:12 +0000' as sent, 'balance ' || c_nationkey as body from customer where c_custkey % 3 <> 0")
def mails_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Mails with their lists; those without a receiver are dropped."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    to = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("To: to"), "c_nationkey", F.lit("@y.test, b@y.test\r\n")))
    text = F.concat(F.lit("From: "), "c_name", F.lit(" <a"), key, F.lit("@x.test>\r\n"), to, F.when(key % 2 == 0, "Cc: c@y.test\r\n").otherwise(""), F.lit("Date: Tue, 05 Mar 2024 10:11:12 +0000\r\nSubject: "), "c_mktsegment", F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbalance "), "c_nationkey")
    return files.mails(_files(c, "c_custkey", text)).drop("error")


@query("select n_regionkey::varchar as path, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as number, 'n' || n_nationkey || '@x.test' as sender, 'to@y.test' as receivers, n_name as subject, 'body of ' || n_name as body from nation")
def mail_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Mail boxes that hold many mails one behind the other."""
    n = table(spark, d, "nation")
    mail = F.concat(F.lit("From x Tue Mar  5 10:11:12 2024\nFrom: n"), "n_nationkey", F.lit("@x.test\nTo: to@y.test\nSubject: "), "n_name", F.lit("\n\nbody of "), "n_name", F.lit("\n\n"))
    boxes = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", mail.alias("m")))), lambda x: x["m"]), "").alias("t"))
    return files.mail_boxes(_files(boxes, "n_regionkey", F.col("t"))).select("path", "number", "sender", "receivers", "subject", F.rtrim("body", F.lit("\n")).alias("body"))


@query("select p_partkey::varchar as path, p_name as title, 'http://x.test/' || p_partkey as link, p_brand || ' ' || p_type as text from part")
def pages_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Title, links and words of pages; scripts aren't words."""
    text = F.concat(F.lit("<html><head><title>"), "p_name", F.lit("</title><script>var a = 1;</script></head><body><p>"), "p_brand", F.lit('</p><a href="http://x.test/'), "p_partkey", F.lit('">'), "p_type", F.lit("</a></body></html>"))
    return files.pages(_files(table(spark, d, "part"), "p_partkey", text)).select("path", "title", F.col("links")[0].alias("link"), "text")


@query("select p_partkey::varchar as path, 'activity ' || p_brand as action, p_name as title, 'http://x.test/' || p_partkey as url, 'Mar 5, 2024, 10:11:12 AM' as at from part")
def activity_pages(spark: SparkSession, d: str) -> DataFrame:
    """Activity pages: one row an entry, with action, title, link and time."""
    cell = F.concat(F.lit('<div class="content-cell">activity '), "p_brand", F.lit('&nbsp;<a href="http://x.test/'), "p_partkey", F.lit('">'), "p_name", F.lit("</a><br>Mar 5, 2024, 10:11:12 AM</div>"))
    return files.activities(_files(table(spark, d, "part"), "p_partkey", F.concat(F.lit("<html><body>"), cell, F.lit("</body></html>")))).select("path", "action", "title", "url", "at")


@query("select s_suppkey::varchar as path, k as key, case k when 'Name' then s_name else '{\"nation\": ' || s_nationkey || '}' end as value from supplier, (values ('Name'), ('Where')) v(k)")
def property_list_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of property lists; nested ones as JSON."""
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>Name</key><string>'), "s_name", F.lit("</string><key>Where</key><dict><key>nation</key><integer>"), "s_nationkey", F.lit("</integer></dict></dict></plist>"))
    return files.property_lists(_files(table(spark, d, "supplier"), "s_suppkey", text)).select("path", "key", "value")


@query("select event_id as row_id, (4000 + event_id % 9)::varchar as event_id, 'Security' as channel, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time_created, case when event_id % 2 = 0 then 'S-1-5-' || user_id end as user_sid from events")
def event_xml_fields(spark: SparkSession, d: str) -> DataFrame:
    """Id, channel, time and user of events in XML."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    security = F.when(n % 2 == 0, F.concat(F.lit('<Security UserID="S-1-5-'), "user_id", F.lit('"/>'))).otherwise("<Security/>")
    xml = F.concat(F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID Qualifiers="0">'), n % 9 + 4000, F.lit("</EventID><Channel>Security</Channel><TimeCreated SystemTime=\""), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"/>'), security, F.lit("</System></Event>"))
    return files.event_texts(e.select(n.alias("row_id"), xml.alias("xml")), "xml").drop("xml")


def _little(value, size: int):
    return texts.reversed_bytes(F.right(F.lpad(F.hex(value), 2 * size, "0"), F.lit(2 * size)))


@query("""select event_id::varchar as path, (v.k * 72)::bigint as "offset", (event_id * 4) % 281474976710656 + 1::bigint * 281474976710656 as reference, 5::bigint as parent, (1000 + v.k)::bigint as usn, (13300000000 + event_id - 11644473600) * 1000000 as time_us, case v.k when 0 then 'FILE_CREATE' else 'DATA_EXTEND CLOSE' end as reason, 'f.tx' as name from events, (values (0), (1)) v(k)""")
def journal_records_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Change-journal records from bytes."""
    n = F.col("event_id")

    def record(k: int, reason: int):
        return F.concat(_little(F.lit(68).cast("bigint"), 4), F.lit("02000000"), _little(n * 4 + (1 << 48), 8), _little(F.lit(5).cast("bigint"), 8), _little(F.lit(1000 + k).cast("bigint"), 8), _little((n + 13_300_000_000) * 10_000_000, 8), _little(F.lit(reason).cast("bigint"), 4), F.lit("00" * 12), F.lit("08003C00"), F.lit("66002E0074007800"), F.lit("00000000"))

    content = F.unhex(F.concat(record(0, 0x100), record(1, 0x80000002)))
    return records.journal(table(spark, d, "events").select(n.cast("string").alias("path"), content.alias("content"))).drop("error")


@query("select event_id::varchar as path, (13300000000 + event_id - 11644473600) * 1000000 as created_us, event_id as size, 'D:\\x.txt' as local_path from events")
def shell_links_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Shell links from bytes."""
    n = F.col("event_id")
    time = _little((n + 13_300_000_000) * 10_000_000, 8)
    info = F.concat(F.lit("2C000000" + "1C000000" + "01000000" + "1C000000" + "20000000" + "00000000" + "28000000"), F.lit("00000000"), F.lit("443A5C782E747874" + "00"))
    content = F.unhex(F.concat(F.lit("4C000000" + "00" * 16 + "02000000" + "00000000"), time, time, time, _little(n, 4), F.lit("00" * 20), info))
    return records.links(table(spark, d, "events").select(n.cast("string").alias("path"), content.alias("content"))).select("path", "created_us", "size", "local_path")


@query("""select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'zip' when 2 then 'olecf' end as kind, case (case lower(ext) when 'pdf' then doc_id % 4 <> 0 when 'docx' then doc_id % 4 <> 1 when 'xlsx' then doc_id % 4 <> 1 when 'pptx' then doc_id % 4 <> 1 when 'hwp' then doc_id % 4 <> 2 when 'doc' then doc_id % 4 <> 2
    when 'xls' then doc_id % 4 <> 2 when 'ppt' then doc_id % 4 <> 2 end) when true then 'Y' when false then 'N' end as is_mismatched, case when doc_id % 3 = 0 then 'tail' end as by_tail from documents""")
def signature_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Types by leading bytes, by bytes counted from the end, and whether the extension promises another."""
    n = F.col("doc_id")
    head = F.when(n % 4 == 0, "25504446").when(n % 4 == 1, "504B0304").when(n % 4 == 2, "D0CF11E0A1B11AE1").otherwise("00000000")
    content = F.unhex(F.concat(head, F.lit("AA" * 20), F.when(n % 3 == 0, "4B4F4C59").otherwise("00000000"), F.lit("FF" * 4)))
    kind = files.signature(F.col("content"))
    docs = table(spark, d, "documents").select("doc_id", "ext", content.alias("content"))
    return docs.select("doc_id", kind.alias("kind"), bits.decoded(files.mismatched(F.col("ext"), kind).cast("int"), {1: "Y", 0: "N"}).alias("is_mismatched"), files.signature(F.col("content"), (("4b4f4c59", -8, "tail"),)).alias("by_tail"))


@query("""select n_nationkey::varchar as path, 'pdf' as kind, 4096::bigint as "offset", 2::bigint as blocks from nation union all select n_nationkey::varchar, 'png', 16384, 1 from nation where n_nationkey % 2 = 0""")
def carved_runs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that begin with a signature, neighbouring ones of a kind as one run."""
    block = lambda head: F.rpad(F.lit(head), 8192, "0")
    content = F.unhex(F.concat(block("00"), block("25504446"), block("25504446"), block("11"), F.when(F.col("n_nationkey") % 2 == 0, block("89504E470D0A1A0A")).otherwise(block("22"))))
    return files.merged_blocks(files.carved(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), content.alias("content")))).select("path", "kind", "offset", "blocks")


@query("""select r_regionkey::varchar as path, number, start_sector::bigint as start_sector, sectors::bigint as sectors, kind from region, (values (0, 2048, 1000, 'NTFS/exFAT'), (1, 4096, 500, 'FAT32'), (3, 8192, 70000, 'Linux')) v(number, start_sector, sectors, kind)""")
def partition_tables(spark: SparkSession, d: str) -> DataFrame:
    """Partitions that a master boot record lists."""
    entry = lambda kind, start, n: F.concat(F.lit("00000000"), F.lit(kind), F.lit("000000"), _little(F.lit(start).cast("bigint"), 4), _little(F.lit(n).cast("bigint"), 4))
    content = F.unhex(F.concat(F.lit("00" * 446), entry("07", 2048, 1000), entry("0C", 4096, 500), F.lit("00" * 16), entry("83", 8192, 70000), F.lit("55AA")))
    return records.partitions(table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("path"), content.alias("content"))).select("path", "number", "start_sector", "sectors", "kind")


@query("select event_id::varchar as path, event_id * 3 as size, (13300000000 + event_id - 11644473600) * 1000000 as deleted_us, 'C:\\a.b' as original_path from events")
def recycle_bin_entries(spark: SparkSession, d: str) -> DataFrame:
    """Index files of a recycle bin, of the older and the newer version."""
    n = F.col("event_id")
    name = "43003A005C0061002E0062000000"
    old, new = F.rpad(F.lit(name), 1040, "0"), F.concat(F.lit("07000000"), F.lit(name))
    content = F.unhex(F.concat(F.when(n % 2 == 0, "0100000000000000").otherwise("0200000000000000"), _little(n * 3, 8), _little((n + 13_300_000_000) * 10_000_000, 8), F.when(n % 2 == 0, old).otherwise(new)))
    return records.recycled(table(spark, d, "events").select(n.cast("string").alias("path"), content.alias("content"))).select("path", "size", "deleted_us", "original_path")


@query("select s_suppkey::varchar as path, 'zipfile.BadZipFile' as error from supplier")
def damaged_archives(spark: SparkSession, d: str) -> DataFrame:
    """Files that can't be decoded come out with the kind of error instead of silently not at all."""
    return files.zip_entries(_files(table(spark, d, "supplier"), "s_suppkey", F.col("s_name")), errors=True).filter("error is not null").select("path", "error")


@query("""with k as (select p_partkey::varchar as path, fact, v from part, (values ('hostname', 1), ('time_zone', 2), ('product', 3)) f(fact, v)) select path, fact, case v when 1 then p_name when 2 then p_brand else p_type end as value from k join part on p_partkey::varchar = path""")
def system_fact_values(spark: SparkSession, d: str) -> DataFrame:
    """What registry values tell about systems: of two control sets the first counts."""
    p = table(spark, d, "part").withColumn("path", F.col("p_partkey").cast("string"))
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), v.alias("value")) for k, n, v in (
        ("ControlSet001/Control/ComputerName/ComputerName", "ComputerName", F.col("p_name")), ("ControlSet002/Control/ComputerName/ComputerName", "ComputerName", F.lit("other")), ("ControlSet001/Control/TimeZoneInformation", "timezonekeyname", F.col("p_brand")),
        ("Microsoft/Windows NT/CurrentVersion", "ProductName", F.col("p_type")), ("Microsoft/Windows NT/CurrentVersion", "Other", F.lit("x")))))
    return hives.system_facts(p.select("path", F.inline(rows)))


@query("""select c_custkey::varchar as path, 'S-1-5-21-' || c_custkey as sid, 'C:/Users/u' || c_nationkey as folder, 'u' || c_nationkey as user from customer""")
def user_account_folders(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by their user's identifier."""
    c = table(spark, d, "customer")
    key = F.concat(F.lit("Microsoft/Windows NT/CurrentVersion/ProfileList/S-1-5-21-"), "c_custkey")
    return hives.user_accounts(c.select(F.col("c_custkey").cast("string").alias("path"), key.alias("key"), F.lit("ProfileImagePath").alias("name"), F.concat(F.lit("C:/Users/u"), "c_nationkey").alias("value")))


@query("select ext, createdtime, count(*) as versions from (select distinct ext, source, createdtime, lang from documents) group by 1, 2")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """Files that several snapshots hold, once for each state of their times."""
    docs = table(spark, d, "documents").withColumn("inode", F.concat_ws("|", F.coalesce("ext", F.lit("?")), F.coalesce("source", F.lit("?"))))
    return files.unique_versions(docs, "inode", ["createdtime", "lang"]).groupBy("ext", "createdtime").agg(F.count(F.lit(1)).alias("versions"))


@query("""select p_partkey::varchar as path, p_name || '.EXE' as name, 30 as version, p_size as run_count, [(13300000000 + p_partkey - 11644473600) * 1000000] as run_us from part""")
def prefetch_files(spark: SparkSession, d: str) -> DataFrame:
    """Prefetch files from bytes."""
    p = table(spark, d, "part")
    name = F.rpad(F.regexp_replace(F.hex(F.encode(F.concat("p_name", F.lit(".EXE")), "US-ASCII")), "(..)", "$100"), 120, "0")
    head = F.concat(F.lit("1E000000" + "53434341" + "00" * 8), name, F.lit("00" * 8), F.lit("30010000"), F.lit("00" * 40))
    content = F.unhex(F.concat(head, _little((F.col("p_partkey") + 13_300_000_000) * 10_000_000, 8), F.lit("00" * 56), F.lit("00" * 16), _little(F.col("p_size").cast("bigint"), 4), F.lit("00" * 88)))
    return records.prefetched(p.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))


# ------------------------------------------------------------------ detectors

_PHONES = (r"^\+?[0-9]{8,14}$", r"^[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}$", r"^\+[0-9]{1,3}-[0-9]{1,4}-[0-9]{3,4}-[0-9]{4}$", r"^\([0-9]{2,4}\) ?[0-9]{3,4}-[0-9]{4}$")
_NOW, _FIRST = 1_767_225_600, 1_199_145_600


def semantic_sql(value: str, column: str) -> str:
    """One CASE for (type|format); ``value`` and ``column`` are expressions."""
    v, c = value, f"upper({column})"
    free = f"contains({c}, 'EXPIR')"
    number = f"try_cast({v} as decimal(20,0))"
    within = lambda seconds: f"({free} or ({seconds}) between {_FIRST} and {_NOW})"
    digits = f"regexp_full_match({v}, '[0-9]+')"
    day = f"try_strptime(substring({v}, 1, 8), '%Y%m%d')"
    has = lambda p: f"regexp_matches({v}, '{p}')"
    whole = f"floor(abs(try_cast({v} as double)))"
    phone = " or ".join(has(p) for p in _PHONES)
    n = f"length({v})"
    digit_count = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    rules = [
        (f"{v} is null or length(trim({v}, ' ')) <= 3 or upper({v}) in ('TRUE', 'FALSE', 'NULL', 'NONE') or {has('^0+(?:[.]0+)?$')} or {has('^-[0-9]+(?:[.][0-9]+)?$')} and not {has('^-?[0-9]{1,3}[.][0-9]{3,}$')} or ((suffix({c}, '_ID') or suffix({column}, 'ID') or {c} = 'ID') and {digits})", "UNKNOWN|UNKNOWN"),
        *((f"{digits} and {n} = {k} and {within(f'{number} / {by}' if by > 1 else number)}", f"TIMESTAMP|{form}") for k, by, form in ((10, 1, "unixtime"), (13, 1000, "unixtime_millisec"), (16, 1_000_000, "unixtime_microsec"), (19, 1_000_000_000, "unixtime_nanosec"))),
        (f"{digits} and {n} = 17 and {within(f'{number} / 1000000 - 11644473600')}", "TIMESTAMP|chrome_time"),
        *((f"{digits} and {n} = {k} and {day} is not null and {within(f'epoch({day})')}", f"TIMESTAMP|{form}") for k, form in ((8, "yyyymmdd"), (14, "yyyymmddhhmmss"))),
        (f"{has('^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?')} or {has('^[0-9]{4}[./][0-9]{2}[./][0-9]{2}(?: [0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?$')}", "TIMESTAMP|datetime"),
        (f"{has('^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$')} and {n} between 10 and 50", "ACCOUNT|email"),
        (has("^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"), "IP|ipv4"), (has("^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), "MAC|mac"),
        (f"{n} >= 15 and {has('^(?i:https?://|www[.])[^ ]+$')}", "URL|url"),
        (f"({phone}) and not (contains({c}, 'TIME') or contains({c}, 'VERSION') or contains({c}, 'KEY')) and {digit_count} > 7 and {digit_count} < 15", "PHONE|phonenumber"),
        (f"{has('^-?[0-9]{1,3}[.][0-9]{3,}$')} and {whole} between 123 and 133", "GEODATA|longitude"), (f"{has('^-?[0-9]{1,3}[.][0-9]{3,}$')} and {whole} between 31 and 40", "GEODATA|latitude"),
        (f"{digits} and (contains({c}, 'LONGITUDE') or {c} = 'LNG' or {c} = 'LON')", "GEODATA|longitude"), (f"{digits} and (contains({c}, 'LATITUDE') or {c} = 'LAT')", "GEODATA|latitude"),
        (has("^(?:/|[A-Za-z]:[\\\\/]|file:|content:)[^\\n]*$"), "FILE|path"), (f"contains({c}, 'PASSW') or contains({c}, 'PWD')", "PASSWORD|string"), (f"contains({c}, 'CIPHER') or contains({c}, 'ENCRYPT')", "CIPHER|string"),
        (f"{has('^[A-Za-z][A-Za-z0-9_]*(?:[.][A-Za-z][A-Za-z0-9_]*){1,7}$')} and {n} <= 60 and contains({v}, '.')", "PACKAGE|package"), (f"(contains({c}, 'DURATION') or contains({c}, 'SECONDS')) and {digits}", "DURATION|digit_positive"), (f"contains({c}, 'SIZE') and {digits}", "FILE|size"),
    ]
    return "case " + " ".join(f"when {rule} then '{name}'" for rule, name in rules) + " else 'UNKNOWN|UNKNOWN' end"


_SEMANTIC = {
    "web_browser_history": ["timestamp", "url", "file", "source", "digit_positive", "package_name"], "call_history": ["phonenumber", "timestamp", "time_duration", "row_id"], "geodata": ["longitude", "latitude", "package_name", "timestamp"],
    "id_password_hash": ["account", "pwd", "url", "contents"], "lv1_os_win_reg_user_assist": ["file_name", "focus_seconds", "last_run_time"], "partition_info": ["par_size", "sector_size", "par_id"], "customer": ["c_acctbal", "c_name"],
}


def _long_sql(columns: dict[str, list[str]]) -> str:
    return " union all ".join(f"""select '{t}' as "table", '{c}' as "column", {c}::varchar as value from {t}""" for t, cs in columns.items() for c in cs)


_PLAIN_SQL = "case when regexp_full_match(value, '[^\\n]*\\([A-Za-z0-9_]+:[A-Za-z0-9_]+\\)') then regexp_extract(value, '^(.*)\\(([A-Za-z0-9_]+):([A-Za-z0-9_]+)\\)$', 1) else value end"


def _long(spark: SparkSession, d: str, columns: dict[str, list[str]]) -> DataFrame:
    return R.union_of([A.long_form(table(spark, d, t), t, c) for t, c in columns.items()])


@query(f"""with v as (select "table", "column", {_PLAIN_SQL} as value from ({_long_sql(_SEMANTIC)})), k as (select "table", "column", {semantic_sql("value", '"column"')} as t from v)
    select "table", "column", split_part(t, '|', 1) as type, split_part(t, '|', 2) as format, count(*) as cnt from k group by all""")
def semantic_types(spark: SparkSession, d: str) -> DataFrame:
    """The semantic types of all values of several tables' columns."""
    values = _long(spark, d, _SEMANTIC).withColumn("value", texts.annotated(F.col("value"))["value"])
    kinds = values.select("table", "column", semantic_type(F.col("value"), F.col("column")).alias("t"))
    return kinds.groupBy("table", "column", "t.type", "t.format").agg(F.count(F.lit(1)).alias("cnt"))


_PROFILED = {
    "web_browser_history": ["timestamp", "url", "file", "source", "digit_positive"], "call_history": ["phonenumber", "timestamp", "time_duration"], "geodata": ["longitude", "latitude", "package_name"], "id_password_hash": ["account", "pwd", "url"],
}


@query(f"""with v as (select distinct * from ({_long_sql(_PROFILED)}) where value is not null), r as (select *, row_number() over (partition by "table", "column" order by encode(value) desc) as r from v), k as (select "table", "column", {semantic_sql("value", '"column"')} as t from r where r <= 50)
    select "table", "column", split_part(t, '|', 1) as type, split_part(t, '|', 2) as format, count(*) as cnt from k where t <> 'UNKNOWN|UNKNOWN' group by all""")
def semantic_profile(spark: SparkSession, d: str) -> DataFrame:
    """Semantic types among the greatest values of each column: a profile by sampling, which is the feature."""
    return A.profile(_long(spark, d, _PROFILED))


# ------------------------------------------------------------------ classifier


@query("""with w as (select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(author, ''), '["''\\[\\]()0-9]', '', 'g')), '[^\\pL\\pN]+'), lambda x: x <> ''))) as words from documents)
    select doc_id, array_to_string(list_concat(list_resize([]::varchar[], greatest(4 - len(words), 0)::bigint, ''), words[1:4]), '|') as words from w""")
def padded_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words in order, filled up on the left."""
    words = classifier.word_sets(table(spark, d, "documents").select("doc_id", "author"), "author")
    return words.select("doc_id", F.array_join(classifier.padded(F.col("words"), 4), "|").alias("words"))


_PREDICTED = "select event_id, event_type as label, case when event_id % 4 = 0 then 'click' else event_type end as predicted, (event_id * 37 % 1000) / 1000.0 + case when event_type = 'purchase' then 0.25 else 0 end as score from events"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    score = F.pmod(F.col("event_id") * 37, F.lit(1000)) / 1000 + F.when(F.col("event_type") == "purchase", 0.25).otherwise(0.0)
    return e.select("event_id", F.col("event_type").alias("label"), F.when(F.col("event_id") % 4 == 0, "click").otherwise(F.col("event_type")).alias("predicted"), F.round(score, 6).alias("score"))


@query(f"""with p as ({_PREDICTED}), c as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as c), m as (select c, (select count(*) from p where label = c) as t, (select count(*) from p where predicted = c) as m, (select count(*) from p where label = c and predicted = c) as h from c),
    s as (select *, case when m > 0 then h / m else 0 end as p, case when t > 0 then h / t else 0 end as r from m where t + m > 0), i as (select event_type, row_number() over (order by event_type) - 1 as k from (select distinct event_type from events))
    select round((select sum(h) / sum(t) from s), 9) as accuracy, round(avg(p), 9) as precision, round(avg(r), 9) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 9) as f1,
    (select round(sqrt(avg((a.k - b.k) * (a.k - b.k))), 9) from p join i a on a.event_type = label join i b on b.event_type = predicted) as rmse from s""")
def classifier_figures(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and the error of class numbers."""
    counts = classifier.confusion(_predicted(spark, d), "label", "predicted")
    one = classifier.figures(counts, "label", "predicted").crossJoin(classifier.rmse(counts, "label", "predicted"))  # one row and one row
    return one.select(*(F.round(c, 9).alias(c) for c in one.columns))


@query(f"""with p as ({_PREDICTED}), s as (select round(score, 6) as score, sum((label = 'purchase')::int) as pos, sum((label <> 'purchase')::int) as neg from p group by 1), w as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s)
    select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) as roc_auc from w""")
def roc_auc_of_scores(spark: SparkSession, d: str) -> DataFrame:
    """The share of pairs of a positive and a negative row that the scores put in order; ties count half."""
    p = _predicted(spark, d).select("score", (F.col("label") == "purchase").alias("positive"))
    return classifier.roc_auc(p, "score", "positive").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("select event_id, event_type as decoded from events")
def one_hot_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Classes to indicator arrays and back by the place of the greatest."""
    classes = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().limit(1000).collect())
    hot = table(spark, d, "events").select("event_id", classifier.one_hot(F.col("event_type"), classes).alias("h"))
    return hot.select("event_id", classifier.argmax(F.col("h"), classes).alias("decoded"))


QUERIES, ORACLES = CASES.functions, CASES.sql
