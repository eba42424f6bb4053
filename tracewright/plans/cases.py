"""Whole analyses, browser and phone histories, bound to the driver's tables, and the same in SQL written on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import bits
from tracewright.plans import analyses, browser, events, mobile
from tracewright.plans.registering import Queries
from tracewright.session import table

CASES = Queries()
query = CASES.query


def _no_tags() -> list[Column]:
    return [F.lit(None).cast("string").alias(c) for c in analyses.TAGS]


def _at(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def at_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def clock_sql(seconds: str) -> str:
    """h:mm:ss with days before it, of a number that isn't negative."""
    s = f"({seconds})"
    return f"(case when {s} // 86400 = 0 then '' when {s} // 86400 = 1 then '1 day, ' else ({s} // 86400)::varchar || ' days, ' end || ({s} % 86400 // 3600)::varchar || ':' || lpad(({s} % 3600 // 60)::varchar, 2, '0') || ':' || lpad(({s} % 60)::varchar, 2, '0'))"


def _told_sql(**fields: str) -> str:
    return " || ', ' || ".join(f"'{k}:' || coalesce(({v})::varchar, '')" for k, v in fields.items())


def _timeline_sql() -> str:
    part = lambda source, kind, when, duration, told, tags="par_id, case_id, evd_id": f"select {tags}, '{kind}' as event_type, ({when})::varchar as event_time, {duration} as duration, {told} as description from {source}"
    none = "'00:00:00'"
    downloads = [
        part(f"web_browser_history where row_id % 5 = {i}", "Web Download", at_sql("loaded_at"), f"case when row_id % 7 = 0 then {none} else {clock_sql('row_id % 100000')} end", _told_sql(browser=f"'{name}'", source="url", file_path="file", os_account="account", profile="package_name"))
        for i, name in enumerate(("Chrome", "Chromium Edge", "Firefox", "Opera", "Whale"))
    ]
    seconds = "try_cast(split_part(time_duration, '(', 1) as bigint)"
    return " union all ".join([
        part("call_history", "Call", "timestamp", clock_sql(seconds), _told_sql(**{"from": "account", "to": "phonenumber", "call_type": "digit_positive"})),
        part("geodata", "Message(MMS)", "timestamp", none, _told_sql(**{"from": "package_name", "to": "longitude", "content": "contents"})),
        part("id_password_hash", "Message(SMS)", "timestamp", none, _told_sql(**{"from": "case when row_id % 3 = 2 then account end", "to": "case when row_id % 3 <> 2 then account end", "content": "contents"})),
        part("lv1_os_win_reg_user_assist", "Android App", "last_run_time", clock_sql("try_cast(focus_count as bigint) * 61"), _told_sql(package="file_name", source="type")),
        *downloads,
        part("partition_info", "USB Connection", at_sql("loaded_at"), none, _told_sql(source="par_type", friendly_name="par_name", serial_number="md5", device_description="par_label", drive_letter="filesystem"), "null, null, null"),
        part("evidence_info", "USB Connection", at_sql("acquired_date"), none, _told_sql(manufacturer="main_type", model="sub_type", serial_number="md5", event_id="row_id", event_id_description="evd_name", source="evd_path"), "null, null, null"),
    ])


@query(_timeline_sql())
def timeline_sources(spark: SparkSession, d: str) -> DataFrame:
    """The timeline over all its eleven sources."""
    t = lambda n: table(spark, d, n)
    tags = analyses.TAGS
    web = t("web_browser_history").select("row_id", *tags, _at("loaded_at").alias("start_time"), F.col("url"), F.col("file").alias("path"), "account", F.col("package_name").alias("profile"),
                                          F.when(F.col("row_id") % 7 == 0, "").otherwise(_at(F.timestamp_add("SECOND", (F.col("row_id") % 100000).cast("int"), F.date_trunc("second", "loaded_at")))).alias("end_time"))
    direction = F.when(F.col("row_id") % 3 == 0, "Sent").when(F.col("row_id") % 3 == 1, "SENT").otherwise("Received")
    tables = {
        "calls": t("call_history").select(*tags, F.col("timestamp").alias("date"), F.substring_index("time_duration", "(", 1).alias("duration"), F.col("account").alias("sender"), F.col("phonenumber").alias("number"), F.col("digit_positive").alias("type")),
        "mms": t("geodata").select(*tags, F.col("timestamp").alias("date"), F.col("package_name").alias("sender"), F.col("longitude").alias("address"), F.col("contents").alias("body")),
        "sms": t("id_password_hash").select(*tags, F.col("timestamp").alias("date"), direction.alias("direction"), F.col("account").alias("address"), F.col("contents").alias("body")),
        "app_usage": t("lv1_os_win_reg_user_assist").select(*tags, F.col("last_run_time").alias("last_time"), (F.col("focus_count").try_cast("bigint") * 61000).cast("string").alias("active_ms"), F.col("file_name").alias("package"), F.col("type").alias("origin")),
        **{f"downloads_{k}": web.filter(F.col("row_id") % 5 == i) for i, k in enumerate(("chrome", "edge", "firefox", "opera", "whale"))},
        "usb": t("partition_info").select(*_no_tags(), _at("loaded_at").alias("last_connected"), F.col("par_type").alias("origin"), F.col("par_name").alias("name"), F.col("md5").alias("serial"), F.col("par_label").alias("description"), F.col("filesystem").alias("drive")),
        "usb_events": t("evidence_info").select(*_no_tags(), _at("acquired_date").alias("time"), F.col("main_type").alias("manufacturer"), F.col("sub_type").alias("model"), F.col("md5").alias("serial"), F.col("row_id").alias("event_id"), F.col("evd_name").alias("description"), F.col("evd_path").alias("origin")),
    }
    return analyses.timeline(tables)


@query(f"""select null as par_id, null as case_id, null as evd_id, 'Chat' as kind, case when c_custkey % 4 = 0 then 'Outgoing' else 'Incoming' end as direction, coalesce(c_name, n_name) as partner, {at_sql("ts")} || 'Z' as at, substring(event_type, 3, 3) as message
        from events join customer on c_custkey = user_id join nation on n_nationkey = user_id % 25
    union all select par_id, case_id, evd_id, 'SMS', case when row_id % 3 = 2 then 'Incoming' else 'Outgoing' end, account, timestamp || 'Z', substring(contents, 3, 3) from id_password_hash
    union all select par_id, case_id, evd_id, 'MMS', case when row_id % 2 = 0 then 'Outgoing' else 'Incoming' end, latitude, timestamp || 'Z', substring(contents, 3, 3) from geodata
    union all select par_id, case_id, evd_id, 'Call', digit_positive, phonenumber, timestamp || 'Z', '' from call_history""")
def communication_sources(spark: SparkSession, d: str) -> DataFrame:
    """Chats (three tables), SMS, MMS and calls as one."""
    t = lambda n: table(spark, d, n)
    tags = analyses.TAGS
    direction = F.when(F.col("row_id") % 3 == 0, "Sent").when(F.col("row_id") % 3 == 1, "SENT").otherwise("Received")
    return analyses.communication({
        "chats": t("events").select(*_no_tags(), F.col("user_id").alias("friend_id"), (F.col("user_id") % 25).alias("room_id"), _at("ts").alias("date"), F.col("event_type").alias("message")),
        "friends": t("customer").select(F.col("c_custkey").alias("friend_id"), F.when(F.col("c_custkey") % 4 != 0, "1").alias("phone"), F.col("c_name").alias("name")),
        "rooms": t("nation").select(F.col("n_nationkey").cast("bigint").alias("room_id"), F.col("n_name").alias("title")),
        "sms": t("id_password_hash").select(*tags, direction.alias("direction"), F.col("account").alias("address"), F.col("timestamp").alias("date"), F.col("contents").alias("body")),
        "mms": t("geodata").select(*tags, F.when(F.col("row_id") % 2 == 0, "insert-address-token").otherwise("x").alias("sender"), F.col("latitude").alias("address"), F.col("timestamp").alias("date"), F.col("contents").alias("body")),
        "calls": t("call_history").select(*tags, F.col("digit_positive").alias("type"), F.col("phonenumber").alias("number"), F.col("timestamp").alias("date")),
    })


_BASE = "regexp_extract(replace({0}, chr(92), '/'), '[^/]*$', 0)"
_RUN = "select par_id, case_id, evd_id, {name} as process_name, {when} as execution_time, {path} as process_path, '{label}' as source from {table}"


@query(" union all ".join([
    _RUN.format(name=_BASE.format("file_name"), when="last_run_time", path="file_name", label="UserAssist", table="lv1_os_win_reg_user_assist where try_cast(last_run_time as timestamptz) > timestamptz '1970-01-01 00:00:00+00'"),
    _RUN.replace("par_id, case_id, evd_id", "null, null, null").format(name=_BASE.format("evd_path"), when=at_sql("acquired_date"), path="evd_path", label="Amcache", table="evidence_info where acquired_date > '1970-01-01'"),
    _RUN.format(name=_BASE.format("title"), when=at_sql("loaded_at"), path="title", label="Timeline", table="documents where doc_id % 3 = 0"),
    _RUN.format(name=_BASE.format("source"), when=at_sql("loaded_at"), path="source", label="EventLog - Application", table="call_history"),
    _RUN.format(name=_BASE.format("source"), when=at_sql("loaded_at"), path="source", label="Jump List", table="geodata"),
    "select null, null, null, 'P' || o_orderkey || '.EXE', strftime(o_orderdate + to_days(k::int), '%Y-%m-%d %H:%M:%S'), '/run/' || o_custkey, 'Prefetch' from orders, (values (0), (1), (3)) v(k)",
]))
def app_history_sources(spark: SparkSession, d: str) -> DataFrame:
    """Executions from six traces; prefetch has a time of creation and up to eight runs, of which some say nothing."""
    t = lambda n: table(spark, d, n)
    day = lambda n: F.date_format(F.col("o_orderdate") + F.expr(f"interval {n} days"), "yyyy-MM-dd HH:mm:ss")
    tags = analyses.TAGS
    return analyses.app_history({
        "user_assist": t("lv1_os_win_reg_user_assist"),
        "amcache": t("evidence_info").select(*_no_tags(), F.col("evd_path").alias("path"), _at("acquired_date").alias("modified")),
        "activities": t("documents").select(*tags, F.col("title").alias("path"), F.when(F.col("doc_id") % 3 == 0, _at("loaded_at")).when(F.col("doc_id") % 3 == 1, "1601-01-01T00:00:00").alias("start_time")),
        "event_applications": t("call_history").select(*tags, F.col("source").alias("path"), _at("loaded_at").alias("time")),
        "jump_lists": t("geodata").select(*tags, F.col("source").alias("path"), _at("loaded_at").alias("time")),
        "prefetch": t("orders").select(*_no_tags(), F.concat(F.lit("P"), "o_orderkey", F.lit(".EXE")).alias("name"), F.concat(F.lit("/run/"), "o_custkey").alias("path"), day(0).alias("created"),
                                       F.concat_ws(",", day(1), F.lit(" "), day(3), F.lit("1960-01-01 00:00:00")).alias("run_times")),
    })


_MTIME = "epoch(o_orderdate)::bigint + case when o_orderkey % 3 = 0 then 11644473600 else 0 end"
_CTIME = "epoch(o_orderdate)::bigint + case when o_orderkey % 3 = 0 then 11644473600 else 0 end + o_custkey % 3 - 1"


def _shown_sql(seconds: str, nano: str) -> str:
    return f"strftime(make_timestamp((({seconds}) - case when greatest({_MTIME}, {_CTIME}) > 11644473600 then 11644473600 else 0 end) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || ({nano})::varchar || 'Z'"


@query(f"""select o_orderkey, case when ({_MTIME}) < ({_CTIME}) or (({_MTIME}) = ({_CTIME}) and o_custkey % 1000 < o_orderkey % 1000) then 'Y' else 'N' end as is_copied, {_shown_sql(_MTIME, "o_custkey % 1000")} as mtime_text, {_shown_sql(_CTIME, "o_orderkey % 1000")} as ctime_text
    from orders where o_orderkey % 10 > 1""")
def file_history_times(spark: SparkSession, d: str) -> DataFrame:
    """Files with both epochs; slack space and files of unknown type are left out."""
    o = table(spark, d, "orders")
    base = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400 + F.when(F.col("o_orderkey") % 3 == 0, F.lit(11_644_473_600)).otherwise(F.lit(0))
    files = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, 7).when(F.col("o_orderkey") % 10 > 1, 1).alias("type"), base.alias("mtime"), (F.col("o_custkey") % 1000).alias("mtime_nano"), (base + F.col("o_custkey") % 3 - 1).alias("ctime"), (F.col("o_orderkey") % 1000).alias("ctime_nano"))
    return analyses.file_history(files).select("o_orderkey", "is_copied", "mtime_text", "ctime_text")


@query("""with r as (select o_orderkey as reference, o_custkey::varchar as size from orders where o_orderstatus <> 'F'),
    c as (select l_orderkey as reference, l_linenumber, case l_linenumber % 4 when 0 then '' when 1 then 'FILE_DELETE' when 2 then 'FILE_CREATE' else 'X' end as change from lineitem where l_returnflag = 'R')
    select coalesce(r.reference, c.reference) as reference, l_linenumber, case when r.reference is null then '?' else size end as size, case when c.reference is null then 'MFT_FILE_CREATE' else change end as change
    from r full join c on r.reference = c.reference where r.reference is null or c.reference is null or change <> ''""")
def journal_history_merge(spark: SparkSession, d: str) -> DataFrame:
    """File records and journal changes by reference: of a change's words the deletion, else nothing if it ends closed, else the first."""
    reasons = F.element_at(F.array(*(F.lit(x) for x in ("DATA_EXTEND CLOSE", "DATA_EXTEND FILE_DELETE CLOSE", "FILE_CREATE DATA_EXTEND", "X"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    records = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("reference"), F.col("o_custkey").alias("size"))
    changes = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("reference"), "l_linenumber", reasons.alias("reason"))
    return analyses.journal_history(records, changes).select("reference", "l_linenumber", "size", "change")


def _usage_sql() -> str:
    loaded = at_sql("loaded_at")
    part = lambda when, what, kind, text, source, tags="case_id, evd_id": f"select {when} as regdate, '{what}' as evdnc_type, '{kind}' as artifact_type, {text} as information, {tags} from {source}"
    pipe = lambda *cs: " || '|' || ".join(f"coalesce(({c})::varchar, '')" for c in cs)
    office = "documents where (lower(ext) like 'doc%' or lower(ext) like 'xls%' or lower(ext) like 'ppt%' or lower(ext) like 'hwp%' or lower(ext) like 'pdf%') and lower(title) not in ('document.doc', 'hancom.hwp')"
    return "select * from (" + " union all ".join([
        part("createdtime", "Created Time", "File Info", "title", office), part(loaded, "Modified Time", "File Info", "title", f"{office} and {loaded} > createdtime"),
        part(at_sql("acquired_date"), "File/Folder Open", "Link", "evd_path", "evidence_info", "case_id, null"), part(loaded, "File/Folder Open", "Link", "evd_path", "evidence_info", "case_id, null"),
        part(at_sql("ts"), "Log On", "EventLog", "'u' || user_id", "events where event_type = 'signup'", "null, null"), part(at_sql("ts"), "Log Off", "EventLog", "'u' || user_id", "events where event_type = 'error'", "null, null"),
        part(at_sql("o_orderdate"), "System On", "EventLog", "o_orderpriority", "orders where o_orderstatus = 'O'", "null, null"), part(at_sql("o_orderdate"), "System Off", "EventLog", "o_orderpriority", "orders where o_orderstatus = 'F'", "null, null"),
        part(at_sql("l_shipdate"), "Sleep Start", "EventLog", "l_returnflag", "lineitem", "null, null"), part(at_sql("l_shipdate + interval 1 hour"), "Sleep End", "EventLog", "l_returnflag", "lineitem", "null, null"),
        part("'2020-01-01T00:00:00'", "USB Connected", "EventLog", pipe("s_suppkey", "s_name", "s_nationkey"), "supplier where s_suppkey % 3 = 0", "null, null"), part("'2020-01-01T00:00:00'", "USB Disconnected", "EventLog", pipe("s_suppkey", "s_name", "s_nationkey"), "supplier where s_suppkey % 3 = 1", "null, null"),
        part(loaded, "USB Last Connected", "Registry", pipe("par_id", "par_label", "par_name", "md5"), "partition_info", "null, evd_id"), part(loaded, "USB Last Removal", "Registry", pipe("par_id", "par_label", "par_name", "md5"), "partition_info where row_id % 2 = 0", "null, evd_id"),
        part(loaded, "IE Accessed Time - Download", "Web Artifact", "coalesce(source, '')", "geodata"), part(loaded, "IE Accessed Time - History", "Web Artifact", "coalesce(source, '')", "call_history"),
        part(loaded, "Chrome Started Time - Download", "Web Artifact", "coalesce(account, '') || ' | ' || coalesce(replace(file_name, chr(92), '/'), '')", "(select useraccount as account, * from lv1_os_win_reg_user_assist)"),
        part(loaded, "Chrome Updated Time - Search Term", "Web Artifact", "coalesce(account, '')", "web_browser_history"), part(loaded, "Chrome Accessed Time - Visit URL", "Web Artifact", pipe("contents", "replace(url, chr(92), '/')"), "web_browser_history"),
        part(loaded, "Application Execution Time", "Prefetch", "file_name", "lv1_os_win_reg_user_assist where type = 'exe'"),
    ]) + ") where trim(regdate) <> '' and not starts_with(regdate, '1601-01')"


@query(_usage_sql())
def usage_sources(spark: SparkSession, d: str) -> DataFrame:
    """What was done when, from thirteen sources."""
    t = lambda n: table(spark, d, n)
    no = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    both = ["case_id", "evd_id"]
    loaded = _at("loaded_at")
    supply = F.when(F.col("s_suppkey") % 3 == 0, "Connected").when(F.col("s_suppkey") % 3 == 1, "Disconnected")
    return analyses.usage_detail({
        "documents": t("documents").select(*both, F.col("title").alias("name"), F.col("ext").alias("extension"), F.col("createdtime").alias("created"), loaded.alias("modified")),
        "links": t("evidence_info").select("case_id", *no("evd_id"), F.col("evd_path").alias("path"), _at("acquired_date").alias("created"), loaded.alias("written")),
        "logons": t("events").select(*no(*both), F.when(F.col("event_type") == "signup", "LogOn - Success").when(F.col("event_type") == "error", "LogOff").otherwise("other").alias("task"), _at("ts").alias("time"), F.concat(F.lit("u"), "user_id").alias("description")),
        "power": t("orders").select(*no(*both), F.when(F.col("o_orderstatus") == "O", "System On").when(F.col("o_orderstatus") == "F", "System Off").alias("task"), _at("o_orderdate").alias("time"), F.col("o_orderpriority").alias("description")),
        "sleep": t("lineitem").select(*no(*both), _at("l_shipdate").alias("slept"), F.date_format(F.col("l_shipdate") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss").alias("woke"), F.col("l_returnflag").alias("description")),
        "usb_events": t("supplier").select(*no(*both), supply.alias("task"), F.lit("2020-01-01T00:00:00").alias("time"), F.col("s_suppkey").alias("device"), F.col("s_name").alias("description"), F.col("s_nationkey").alias("serial")),
        "usb": t("partition_info").select(*no("case_id"), "evd_id", loaded.alias("last_connected"), F.lit("").alias("first_connected"), F.lit(" ").alias("first_since_reboot"), F.lit(None).cast("string").alias("driver_installed"), F.lit("1601-01-01T00:00:00").alias("first_installed"),
                                          F.when(F.col("row_id") % 2 == 0, loaded).alias("last_removal"), F.col("par_id").alias("device"), F.col("par_label").alias("description"), F.col("par_name").alias("name"), F.col("md5").alias("serial")),
        "ie_downloads": t("geodata").select(*both, loaded.alias("modified"), F.col("source").alias("url")), "ie_history": t("call_history").select(*both, loaded.alias("modified"), F.col("source").alias("url")),
        "downloads": t("lv1_os_win_reg_user_assist").select(*both, loaded.alias("start_time"), F.col("useraccount").alias("name"), F.col("file_name").alias("url")),
        "search_terms": t("web_browser_history").select(*both, loaded.alias("searched"), F.col("account").alias("term")), "visits": t("web_browser_history").select(*both, loaded.alias("visited"), F.col("contents").alias("title"), "url"),
        "app_history": t("lv1_os_win_reg_user_assist").select(*both, loaded.alias("execution_time"), F.col("file_name").alias("process_name"), F.when(F.col("type") == "exe", "Prefetch").otherwise("UserAssist").alias("source")),
    })


# ------------------------------------------------------------------ browsers

_SITE = "case " + " ".join(f"when contains(url, '{p}') then '{n}'" for p, n in (("google.", "Google"), ("naver.com", "Naver"), ("daum.net", "Daum"), ("bing.com", "Bing"), ("yahoo.", "Yahoo"), ("youtube.com", "YouTube"), ("duckduckgo.", "DuckDuckGo"))) + " else '' end"
_ADDRESSES = "(select row_id, case row_id % 4 when 0 then 'https://www.google.com' when 1 then 'https://search.naver.com' else 'https://tarn.test' end || coalesce(substring(url, 1, 40), '') as url from web_browser_history where row_id % 9 <> 0)"


@query(f"""select regexp_extract(w.url, '[?&]q=([^&]*)', 1) as term, a.url, {_SITE.replace("url", "a.url")} as site, strftime(make_timestamp((13300000000 + w.row_id - 11644473600) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') as visited
    from web_browser_history w join {_ADDRESSES} a on a.row_id = w.row_id where contains(w.url, 'q=')""")
def search_term_history(spark: SparkSession, d: str) -> DataFrame:
    """Searched words and their pages, with the name of the search site."""
    w = table(spark, d, "web_browser_history").select("row_id", "url")
    host = F.when(F.col("row_id") % 4 == 0, "https://www.google.com").when(F.col("row_id") % 4 == 1, "https://search.naver.com").otherwise("https://tarn.test")
    urls = w.filter(F.col("row_id") % 9 != 0).select(F.col("row_id").alias("id"), F.concat(host, F.coalesce(F.substring("url", 1, 40), F.lit(""))).alias("url"), ((F.col("row_id") + 13_300_000_000) * 1_000_000).alias("last_visit_time"))
    terms = w.filter(F.col("url").contains("q=")).select(F.col("row_id").alias("url_id"), F.regexp_extract("url", "[?&]q=([^&]*)", 1).alias("term"))
    return browser.search_terms(terms, urls)


_CORES = "case code % 256 " + " ".join(f"when {k} then '{v}'" for k, v in bits.TRANSITIONS.items()) + " else (code % 256)::varchar end"
_QUALIFIERS = "concat_ws('|', " + ", ".join(f"case when code & {k} <> 0 then '{v}' end" for k, v in bits.TRANSITION_QUALIFIERS.items()) + ")"


@query(f"""with v as (select *, (event_id % 13) + (event_id % 5) * 16777216 + (event_id % 3) * 268435456 as code from events)
    select v.event_id as id, coalesce(c.c_name, '') as url, coalesce(c.c_mktsegment, '') as title, coalesce(pc.c_name, '') as from_url, coalesce(r_name, '') as segment, {_CORES} as core, {_QUALIFIERS} as qualifiers,
    strftime(make_timestamp((13300000000 + v.event_id - 11644473600) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') as visited, {clock_sql("v.event_id * 7")} as duration
    from v left join customer c on c.c_custkey = v.user_id * 11 left join events p on p.event_id = v.event_id - 1 left join customer pc on pc.c_custkey = p.user_id * 11 left join region on r_regionkey = v.event_id % 7""")
def visit_history_full(spark: SparkSession, d: str) -> DataFrame:
    """Visits with url, title, origin and segment; what is missing is empty."""
    e = table(spark, d, "events")
    code = F.col("event_id") % 13 + (F.col("event_id") % 5) * 16_777_216 + (F.col("event_id") % 3) * 268_435_456
    visits = e.select(F.col("event_id").alias("id"), (F.col("user_id") * 11).alias("url"), (F.col("event_id") - 1).alias("from_visit"), (F.col("event_id") % 7).alias("segment_id"), code.alias("transition"), ((F.col("event_id") + 13_300_000_000) * 1_000_000).alias("visit_time"), (F.col("event_id") * 7_000_000).alias("visit_duration"))
    urls = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("title"))
    return browser.visit_history(visits, urls, table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")))


@query(f"""select e.event_id as id, c.c_name as url, c.c_mktsegment as title, coalesce(pc.c_name, (e.event_id - 1)::varchar) as from_url,
    case e.event_id % 12 {" ".join(f"when {k} then '{v}'" for k, v in bits.VISIT_TYPES.items())} else (e.event_id % 12)::varchar end as kind, strftime(make_timestamp(1600000000000000 + e.event_id * 1000000), '%Y-%m-%dT%H:%M:%S') as visited
    from events e left join customer c on c.c_custkey = e.user_id * 11 left join events p on p.event_id = e.event_id - 1 left join customer pc on pc.c_custkey = p.user_id * 11""")
def place_history_raw(spark: SparkSession, d: str) -> DataFrame:
    """Visits of the other family: an unknown origin keeps its raw id; dates are in milliseconds or microseconds by their length."""
    e = table(spark, d, "events")
    when = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") + 1_600_000_000) * 1_000_000).otherwise((F.col("event_id") + 1_600_000_000) * 1000)
    visits = e.select(F.col("event_id").alias("id"), (F.col("user_id") * 11).alias("place_id"), (F.col("event_id") - 1).alias("from_visit"), (F.col("event_id") % 12).alias("visit_type"), when.alias("visit_date"))
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("title"))
    return browser.place_history(visits, places).withColumn("visited", _at("visited"))


@query("""select 'page' || o_orderkey as page_url, s_name as url, l_linenumber as width, l_quantity as height from orders left join
    (select s_suppkey, s_name, w as l_linenumber, w + s_nationkey as l_quantity from supplier, (values (16), (32)) v(w)) on s_suppkey = o_custkey % 150""")
def icon_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Pages, their icons and the icons' bitmaps."""
    mapping = table(spark, d, "orders").select(F.concat(F.lit("page"), "o_orderkey").alias("page_url"), (F.col("o_custkey") % 150).alias("icon_id"))
    icons = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("url"))
    bitmaps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("icon_id"), "s_nationkey", F.explode(F.array(F.lit(16), F.lit(32))).alias("width")).withColumn("height", F.col("width") + F.col("s_nationkey"))
    return browser.icons(mapping, icons, bitmaps)


@query("""select s_suppkey as id, s_name as url, count(o_orderkey) as pages, coalesce(string_agg('page' || o_orderkey, '|' order by 'page' || o_orderkey), '') as page_urls from supplier left join orders on o_custkey % 150 = s_suppkey group by 1, 2""")
def icon_pages(spark: SparkSession, d: str) -> DataFrame:
    """Icons with the list of all their pages; icons without a page are kept."""
    mapping = table(spark, d, "orders").select(F.concat(F.lit("page"), "o_orderkey").alias("page_url"), (F.col("o_custkey") % 150).alias("icon_id"))
    listed = browser.icon_lists(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("url")), mapping)
    return listed.select("id", "url", F.size("page_urls").cast("bigint").alias("pages"), F.array_join("page_urls", "|").alias("page_urls"))


@query("""with t as (select user_id as place_id, event_id as target_id from events where event_type = 'click'), s as (select user_id as place_id, event_id as detail_id from events where event_type = 'purchase'),
    tn as (select *, count(*) over (partition by place_id) as n, row_number() over (partition by place_id order by target_id) as k from t), sn as (select *, count(*) over (partition by place_id) as n, row_number() over (partition by place_id order by detail_id) as k from s)
    select tn.place_id, tn.target_id as target, sn.detail_id as detail from tn join sn on tn.place_id = sn.place_id and ((tn.n = sn.n and tn.k = sn.k) or tn.n <> sn.n)""")
def download_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Targets and details of downloads: by position where there are as many of both, else all of a place."""
    e = table(spark, d, "events")
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("place_id"), F.col("event_id").alias(f"{name}_id"), F.col("event_id").alias(name))
    return browser.downloads(side("click", "target"), side("purchase", "detail"))


@query("""select r_name as profile, '/bar' as path, 'bar' as name, 0 as depth from region union all select r_name, '/bar/' || n_name, n_name, 1 from nation join region on r_regionkey = n_regionkey
    union all select r_name, '/bar/' || n_name || '/' || k, k, 2 from nation join region on r_regionkey = n_regionkey, (values ('a'), ('b')) v(k)""")
def bookmark_tree(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks in nested JSON, one tree a profile."""
    leaves = F.array(*(F.struct(F.lit(k).alias("name")) for k in "ab"))
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.struct(F.col("n_name").alias("name"), leaves.alias("children")).alias("node"))
    bars = nations.groupBy("r_regionkey").agg(F.collect_list("node").alias("children")).join(table(spark, d, "region"), "r_regionkey")
    text = F.to_json(F.struct(F.struct(F.struct(F.lit("bar").alias("name"), "children").alias("bookmark_bar")).alias("roots")))
    return browser.bookmarks(bars.select(F.col("r_name").alias("profile"), text.alias("json")), "json")


@query("select 'c' || c_custkey as id, n_name || '/' || c_name as path from customer join nation on n_nationkey = c_nationkey union all select 'n' || n_nationkey, n_name from nation")
def bookmark_parents(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks that name their parents."""
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("n_name").alias("title"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("title"))
    return browser.bookmark_paths(nations.unionByName(customers))


@query("select url as host, account as name, digit_positive as same_site from web_browser_history union all select source, contents, '' from geodata")
def cookie_columns(spark: SparkSession, d: str) -> DataFrame:
    """Cookies of a newer and an older database: a column that is lacking comes out empty."""
    newer = table(spark, d, "web_browser_history").select(F.col("url").alias("host_key"), F.col("account").alias("name"), F.col("digit_positive").alias("samesite"))
    older = table(spark, d, "geodata").select(F.col("source").alias("host_key"), F.col("contents").alias("name"))
    return browser.cookies(newer).unionByName(browser.cookies(older))


@query("select c_custkey as profile, max(case when k = 'home' then v end) as home, max(case when k = 'folder' then v end) as folder from (select c_custkey, 'home' as k, c_name as v from customer union all select c_custkey, 'folder', c_mktsegment from customer) group by 1")
def required_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Two settings of each profile; a profile that lacks one would be an error."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("profile"), F.lit("home").alias("name"), F.col("c_name").alias("value")).unionByName(c.select(F.col("c_custkey").alias("profile"), F.lit("folder").alias("name"), F.col("c_mktsegment").alias("value")))
    return browser.required_settings(rows, ["home", "folder"])


@query("select event_id as profile, 'k' as key, json_extract_string(props, '$.k') as value from events")
def site_settings_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an object inside preferences."""
    e = table(spark, d, "events").select(F.col("event_id").alias("profile"), F.concat(F.lit('{"profile":{"sites":'), "props", F.lit("}}")).alias("json"))
    return browser.site_settings(e, "json", "$.profile.sites")


# ------------------------------------------------------------------ phones


@query("""select e.event_id as _id, arg_min(case when l_linenumber % 4 = 0 then 'a' || l_partkey end, (l_linenumber, l_partkey, l_suppkey)) filter (l_linenumber % 4 = 0) as "from", arg_min('a' || l_partkey, (l_linenumber, l_partkey, l_suppkey)) filter (l_linenumber % 4 = 1) as "to",
    arg_min('a' || l_partkey, (l_linenumber, l_partkey, l_suppkey)) filter (l_linenumber % 4 = 2) as cc, arg_min('a' || l_partkey, (l_linenumber, l_partkey, l_suppkey)) filter (l_linenumber % 4 = 3) as bcc, strftime(make_timestamp((1600000000 + e.event_id) * 1000000), '%Y-%m-%dT%H:%M:%S') as at, any_value(case when e.event_id % 3 = 0 then e.event_type end) as text
    from events e left join lineitem on l_orderkey = e.event_id group by e.event_id""")
def mms_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with the first address of each role and, if there is one, the text part."""
    e = table(spark, d, "events")
    role = F.element_at(F.array(*(F.lit(x) for x in bits.ADDRESS_ROLES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    addresses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("msg_id"), role.alias("type"), F.concat(F.lit("a"), "l_partkey").alias("address"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("_id"))
    parts = e.select(F.col("event_id").alias("mid"), F.when(F.col("event_id") % 3 == 0, "text/plain").otherwise("image/png").alias("ct"), F.col("event_type").alias("text"))
    return mobile.mms(e.select(F.col("event_id").alias("_id"), (F.col("event_id") + 1_600_000_000).alias("date")), addresses, parts).withColumn("at", _at("at"))


@query(f"""select phonenumber as number, case code {" ".join(f"when {k} then '{v}'" for k, v in bits.CALL_TYPES.items())} else code::varchar end as kind, strftime(make_timestamp((1600000000000 + row_id * 1001) * 1000), '%Y-%m-%d %H:%M:%S.%f') as at, row_id % 997 as seconds
    from (select *, row_id % 9 as code from call_history)""")
def call_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Calls with the names of their kinds."""
    c = table(spark, d, "call_history").select(F.col("phonenumber").alias("number"), (F.col("row_id") % 9).alias("type"), (F.col("row_id") * 1001 + 1_600_000_000_000).alias("date"), (F.col("row_id") % 997).cast("string").alias("duration"))
    return mobile.calls(c).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"""select account as address, case code {" ".join(f"when {k} then '{v}'" for k, v in bits.MESSAGE_BOXES.items())} else code::varchar end as box, case when row_id % 5 <> 0 then strftime(make_timestamp((row_id % 5) * 1000000000), '%Y-%m-%dT%H:%M:%S') end as at, contents as body
    from (select *, row_id % 9 as code from id_password_hash)""")
def sms_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Messages with the names of their boxes; a date of 0 is none."""
    s = table(spark, d, "id_password_hash").select(F.col("account").alias("address"), (F.col("row_id") % 9).alias("type"), (F.col("row_id") % 5 * 1_000_000).alias("date"), F.col("contents").alias("body"))
    return mobile.sms(s).withColumn("at", _at("at"))


@query("select event_id, user_id as sender, coalesce(c_name, '') as name from events left join customer on c_custkey = user_id * 2 and c_nationkey < 15")
def contact_names(spark: SparkSession, d: str) -> DataFrame:
    """Senders by name; unknown ones keep an empty one."""
    people = table(spark, d, "customer").filter("c_nationkey < 15 and c_custkey % 2 = 0").select((F.col("c_custkey") / 2).cast("bigint").alias("id"), F.col("c_name").alias("name"))
    return mobile.contacts(table(spark, d, "events").select("event_id", F.col("user_id").alias("sender")), people)


@query("""with apps as (select row_number() over (order by package_name desc) as uid, package_name as package from (select distinct package_name from call_history where package_name <> '')), roots as (select * from (values (0, '/data/data/'), (1, '/data/user/0/'), (2, '/sdcard/Android/data/'), (3, '/data/app/')) v(k, root)),
    m as (select w.row_id, root || package || '/' as prefix, package, row_number() over (partition by w.row_id order by uid, k) as r from call_history w, apps, roots where starts_with(w.source, root || package || '/'))
    select w.row_id, w.source as path, m.package from call_history w left join m on m.row_id = w.row_id and r = 1""")
def files_by_app(spark: SparkSession, d: str) -> DataFrame:
    """Files and the app whose folder they lie in."""
    calls = table(spark, d, "call_history")
    names = calls.filter("package_name <> ''").select("package_name").distinct()
    # the rank of a name is the number of names after it: a small table of distinct packages
    apps = names.select(F.col("package_name").alias("package"), (-F.conv(F.substring(F.sha2("package_name", 256), 1, 12), 16, 10).cast("bigint")).alias("_h"))
    apps = apps.withColumn("uid", F.translate("package", "".join(map(chr, range(32, 127))), "".join(map(chr, range(126, 31, -1))))).drop("_h")
    return mobile.files_of_apps(calls.select("row_id", F.col("source").alias("path")), apps).select("row_id", "path", F.col("matched_package").alias("package"))


@query("select doc_id, case when upper(sha1(text)) in (select upper(sha1(text)) from documents where doc_id % 5 = 0 and text is not null) then 'Matching' else 'Not Matching' end as known from documents")
def known_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's digest is in a set of known ones, in whatever case either is written."""
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return mobile.known_files(docs, docs.filter("doc_id % 5 = 0").select(F.upper("sha1").alias("digest"))).select("doc_id", "known")


# ------------------------------------------------------------------ events, documents, registry


def _category_sql() -> str:
    rows = ", ".join(f"('{i}', '{c.name}', [{', '.join(repr(ch.lower()) for ch in c.channels)}]::varchar[], '{events.DESCRIPTIONS.get((c.name, i), c.name)}', {'true' if 'TargetUserName' in c.fields else 'false'})" for c in events.CATEGORIES for i in c.ids)
    return f"""with e as (select row_id, (case row_id % 6 when 0 then 4624 when 1 then 1 when 2 then 6005 when 3 then 4663 when 4 then 10000 else 11707 end)::varchar as event_id, case row_id % 4 when 0 then 'SECURITY.evtx' when 1 then 'System.evtx' when 2 then 'Microsoft-Windows-NetworkProfile%4Operational.evtx' end as source, account from call_history),
    r as (select * from (values {rows}) v(id, category, channels, description, has_user))
    select row_id, category, description, case when has_user then nullif(coalesce(account, ''), '') end as user from e join r on id = event_id and (len(channels) = 0 or len(list_filter(channels, lambda c: contains(lower(source), c))) > 0)"""


@query(_category_sql())
def event_categories(spark: SparkSession, d: str) -> DataFrame:
    """The categories of event-log entries, all from one scan."""
    n = F.col("row_id")
    ids = F.element_at(F.array(*(F.lit(x) for x in ("4624", "1", "6005", "4663", "10000", "11707"))), (n % 6 + 1).cast("int"))
    source = F.when(n % 4 == 0, "SECURITY.evtx").when(n % 4 == 1, "System.evtx").when(n % 4 == 2, "Microsoft-Windows-NetworkProfile%4Operational.evtx")
    data = F.concat(F.lit('<Data Name="TargetUserName">'), F.coalesce("account", F.lit("")), F.lit("</Data>"))
    found = events.categorised(table(spark, d, "call_history").select("row_id", ids.alias("event_id"), source.alias("source"), data.alias("data")))
    return found.select("row_id", "category", "description", F.col("values")["TargetUserName"].alias("user"))


@query("""select doc_id, case when title in (select title from documents where doc_id % 7 = 0 and title is not null) then 1 else 0 end as is_downloaded, coalesce((createdtime < strftime(loaded_at, '%Y-%m-%dT%H:%M:%S'))::int, 0) as is_copied, coalesce((lang > strftime(loaded_at, '%Y-%m-%dT%H:%M:%S'))::int, 0) as is_created from documents""")
def document_mark_flags(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were downloaded, copied or born elsewhere."""
    docs = table(spark, d, "documents").select("doc_id", F.col("title").alias("path"), F.col("createdtime").alias("mtime"), _at("loaded_at").alias("ctime"), F.col("lang").alias("inner_created"))
    return analyses.document_marks(docs, docs.filter("doc_id % 7 = 0").select("path")).select("doc_id", "is_downloaded", "is_copied", "is_created")


@query("select par_id as key, max(case when filesystem = 'NTFS' then par_label end) as \"NTFS\", max(case when filesystem = 'FAT32' then par_label end) as \"FAT32\", max(case when filesystem = 'ext4' then par_label end) as ext4 from partition_info group by 1")
def registry_value_columns(spark: SparkSession, d: str) -> DataFrame:
    """Values of a key as columns."""
    values = table(spark, d, "partition_info").select(F.col("par_id").alias("key"), F.col("filesystem").alias("name"), F.col("par_label").alias("value"))
    return analyses.registry_columns(values, "key", "name", "value", ["NTFS", "FAT32", "ext4"])


@query("""select 'SN' || s_suppkey as serial, s_name as device, case when s_suppkey % 2 = 0 then '_??_USBSTOR#Disk#SN' || s_suppkey || '&0#{53f56307}' end as volume, case when s_suppkey % 3 = 0 then chr(65 + (s_suppkey % 26)::int) || ':' end as drive,
    case when s_suppkey % 5 = 0 then 'LABEL' || s_nationkey end as label from supplier""")
def usb_device_keys(spark: SparkSession, d: str) -> DataFrame:
    """USB stores, their volumes, drive letters and labels, joined by the serial that the keys' texts hold."""
    s = table(spark, d, "supplier").withColumn("sn", F.concat(F.lit("SN"), "s_suppkey"))
    inner = F.concat(F.lit("_??_USBSTOR#Disk#"), "sn", F.lit("&0#{53f56307}"))
    letter = F.concat(F.lit("\\DosDevices\\"), F.expr("char(65 + s_suppkey % 26)"), F.lit(":"))
    return analyses.usb_devices(
        s.select(F.concat("sn", F.lit("&0")).alias("serial"), F.col("s_name").alias("device")), s.filter("s_suppkey % 2 = 0").select(inner.alias("key")),
        s.filter("s_suppkey % 3 = 0").select(letter.alias("name"), F.lower(inner).alias("data")), s.filter("s_suppkey % 5 = 0").select(F.concat(F.lower("sn"), F.lit("#LABEL"), "s_nationkey", F.lit("_77")).alias("key")),
    )


QUERIES, ORACLES = CASES.functions, CASES.sql
