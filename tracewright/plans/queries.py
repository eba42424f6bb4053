"""The registered queries of the core, bound to the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import bits, texts, times
from tracewright.functions.detectors import semantic_type, value_class
from tracewright.operators import aggregates as A
from tracewright.operators import joins as J
from tracewright.operators import reshape as R
from tracewright.operators import windows as W
from tracewright.plans.registering import Queries
from tracewright.session import table

CORE = Queries()
query = CORE.query
QUERIES, ORACLES = CORE.functions, CORE.sql


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ------------------------------------------------------------------ aggregates


@query("select strftime(ts, '%Y-%m-%d %H:%M') as period, count(*) as cnt from events group by 1")
def usage_minute_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by_prefix(table(spark, d, "events"), _text("ts"), 16)


_DETAIL = """(select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as t from orders union all
    select strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') from lineitem union all select strftime(ts, '%Y-%m-%d %H:%M:%S') from events)"""


def _detail(spark: SparkSession, d: str) -> DataFrame:
    named = (("orders", "o_orderdate", "Order"), ("lineitem", "l_shipdate", "Shipment"), ("events", "ts", "Event"))
    return R.union_of([table(spark, d, t).select(_text(c).alias("regdate"), F.lit(n).alias("artifact_type")) for t, c, n in named])


@query(f"""with c as (select left(t, 7) as p, count(*) as cnt from {_DETAIL} group by 1), y as (select distinct left(p, 4) as year from c),
    m as (select unnest(range(1, 13)) as m) select year, lpad(m::varchar, 2, '0') as month, coalesce(cnt, 0)::bigint as cnt
    from y cross join m left join c on p = year || '-' || lpad(m::varchar, 2, '0')""")
def usage_dense_months(spark: SparkSession, d: str) -> DataFrame:
    return A.dense_months(A.count_by_prefix(_detail(spark, d), F.col("regdate"), 7))


@query("""with c as (select strftime(ts, '%Y-%m-%d %H:%M') as p, count(*) as cnt from events group by 1), y as (select distinct left(p, 10) as day from c),
    m as (select unnest(range(0, 1440)) as m), g as (select day, lpad((m // 60)::varchar, 2, '0') || ':' || lpad((m % 60)::varchar, 2, '0') as minute from y, m)
    select day, minute, coalesce(cnt, 0)::bigint as cnt from g left join c on p = day || ' ' || minute""")
def usage_dense_minutes(spark: SparkSession, d: str) -> DataFrame:
    return A.dense_minutes(A.count_by_prefix(table(spark, d, "events"), _text("ts"), 16))


_STATES = """select strftime(ts, '%Y-%m') as month, strftime(ts, '%H') as hour, day(ts)::int as day,
    case when bool_or(event_type = 'signup') and bool_or(event_type = 'error') then 4 when bool_or(event_type = 'error') then 3
    when bool_or(event_type = 'signup') then 2 else 1 end::int as state from events group by all"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    return A.heat_states(table(spark, d, "events"), F.col("ts"), F.col("event_type") == "signup", F.col("event_type") == "error")


@query(_STATES)
def usage_heatmap_state(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


@query(f"""with s as ({_STATES}), h as (select distinct month, lpad(h::varchar, 2, '0') as hour from s, range(0, 24) r(h))
    select h.month, h.hour, {', '.join(f"coalesce(max(case when day = {k} then state end), 0)::int as day{k}" for k in range(1, 32))}
    from h left join s using (month, hour) group by all""")
def usage_heatmap_pivot(spark: SparkSession, d: str) -> DataFrame:
    return A.heat_map(_states(spark, d))


@query("""select round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'R'), 0), 2) as returned, round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'A'), 0), 2) as accepted,
    round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'N' and l_linestatus = 'O'), 0), 2) as open, round(sum(l_extendedprice), 2) as total,
    round(coalesce(sum(l_extendedprice) filter (not (l_returnflag in ('R', 'A') or (l_returnflag = 'N' and l_linestatus = 'O'))), 0), 2) as rest from lineitem""")
def conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    one = A.sums_where(table(spark, d, "lineitem"), F.col("l_extendedprice").cast("decimal(18,2)"), {"returned": flag == "R", "accepted": flag == "A", "open": (flag == "N") & (F.col("l_linestatus") == "O")})
    return one.select(*(F.round(F.col(c).cast("double"), 2).alias(c) for c in one.columns))


@query("select event_type, count(*) as cnt, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def frequency_pct(spark: SparkSession, d: str) -> DataFrame:
    return A.shares(table(spark, d, "events"), "event_type")


@query("""select r_name, string_agg(n_name, '|' order by n_nationkey) as joined from nation join region on n_regionkey = r_regionkey group by 1""")
def string_agg_ordered(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(J.sized(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.joined_text(joined, ["r_name"], "n_name", "n_nationkey")


@query("select user_id, min(ts) as first, max(ts) as last, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::bigint as seconds from events group by 1")
def span_seconds(spark: SparkSession, d: str) -> DataFrame:
    return W.spans(table(spark, d, "events"), ["user_id"], "ts")


@query("select count(distinct package_name) as packages, count(*) as n, count(distinct par_id) as volumes from web_browser_history")
def count_and_distinct(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "web_browser_history")
    return w.agg(F.countDistinct("package_name").alias("packages"), F.count(F.lit(1)).alias("n"), F.countDistinct("par_id").alias("volumes"))


@query("""with v as (select 'call_history' as "table", unnest(['phonenumber', 'source', 'timestamp']) as "column", unnest([phonenumber, source, timestamp]) as value from call_history),
    t as (select *, row_number() over (partition by "table", "column" order by encode(value) desc) as r from (select distinct * from v where value is not null)) select "table", "column", value from t where r <= 50""")
def top_column_values(spark: SparkSession, d: str) -> DataFrame:
    return A.top_values(A.long_form(table(spark, d, "call_history"), "call_history", ["phonenumber", "source", "timestamp"]))


@query()
def semantic_profile(spark: SparkSession, d: str) -> DataFrame:
    columns = {"web_browser_history": ["timestamp", "url", "file", "source", "digit_positive"], "call_history": ["phonenumber", "timestamp", "time_duration"], "geodata": ["longitude", "latitude", "package_name"], "id_password_hash": ["account", "pwd", "url"]}
    return A.profile(R.union_of([A.long_form(table(spark, d, t), t, c) for t, c in columns.items()]))


@query("""select case when digit_positive is null or trim(digit_positive) = '' then 'unknown' when regexp_full_match(digit_positive, '[0-9]+') then 'int'
    when regexp_full_match(digit_positive, '[0-9]+\\.[0-9]+') then 'float' when regexp_full_match(digit_positive, '-[0-9]+(\\.[0-9]+)?') then 'negative'
    when regexp_full_match(digit_positive, '\\pL+') then 'alpha' when regexp_full_match(digit_positive, '[\\pL\\pN]+') then 'alnum' else 'text' end as class, count(*) as cnt
    from call_history group by 1""")
def type_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_history").groupBy(value_class(F.col("digit_positive")).alias("class")).agg(F.count(F.lit(1)).alias("cnt"))


@query()
def semantic_types(spark: SparkSession, d: str) -> DataFrame:
    g = A.long_form(table(spark, d, "geodata"), "geodata", ["longitude", "latitude", "timestamp"]).withColumn("value", texts.annotated(F.col("value"))["value"])
    kinds = g.select("column", semantic_type(F.col("value"), F.col("column")).alias("t"))
    return kinds.groupBy("column", "t.type", "t.format").agg(F.count(F.lit(1)).alias("cnt"))


# ------------------------------------------------------------------ joins


@query("""select e.event_id, e.user_id, coalesce(p.event_type, '') as from_type, coalesce(n.n_name, '') as nation, coalesce(c.c_name, e.user_id::varchar) as customer
    from events e left join events p on p.event_id = e.event_id - 1 left join customer c on c.c_custkey = e.user_id left join nation n on n.n_nationkey = c.c_nationkey""")
def visit_history_joins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("from_type"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("customer"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    joined = e.join(before, "event_id", "left").join(customer.join(J.sized(nation), "n_nationkey", "left"), "user_id", "left")
    return joined.select("event_id", "user_id", F.coalesce("from_type", F.lit("")).alias("from_type"), F.coalesce("nation", F.lit("")).alias("nation"), F.coalesce("customer", F.col("user_id").cast("string")).alias("customer"))


@query("""select c_mktsegment, o_orderpriority, count(*) as lines, round(sum(l_quantity), 2) as quantity from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("n").alias("lines"), F.round(F.sum("q"), 2).alias("quantity"))


@query("select l_orderkey as o_orderkey, " + ", ".join(f"arg_min(l_quantity, (l_linenumber, l_quantity)) filter (l_returnflag = '{f}') as first_{f.lower()}" for f in "RAN") + " from lineitem group by 1")
def scalar_subquery_first(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    first = J.first_by_role(lines, "l_orderkey", "l_returnflag", "l_quantity", F.struct("l_linenumber", "l_quantity"), {"R": "first_r", "A": "first_a", "N": "first_n"})
    return first.withColumnRenamed("l_orderkey", "o_orderkey")


@query("""with s as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'signup'),
    p as (select event_id as bought, user_id, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'purchase')
    select user_id, event_id, bought from s join p using (user_id, n)""")
def positional_zip_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    right = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("bought"), "user_id", F.col("ts").alias("at"))
    return J.zipped(e.filter("event_type = 'signup'"), right, [F.col("ts"), F.col("event_id")], [F.col("at"), F.col("bought")], ["user_id"]).select("user_id", "event_id", "bought")


@query("select row_id, case when upper(md5) in (select upper(md5) from partition_info where md5 is not null) then 'Matching' else 'Not Matching' end as known from evidence_info")
def semi_flag_hash(spark: SparkSession, d: str) -> DataFrame:
    return J.flagged(table(spark, d, "evidence_info"), F.upper("md5"), table(spark, d, "partition_info"), F.upper("md5"), "known").select("row_id", "known")


@query("""select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name not in ('REGION_0') and n_name <> 'NATION_7' and not (r_name = 'REGION_2' and n_name = 'NATION_2')
    and not (r_name = (select min(r_name) from region))""")
def anti_rules(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region")
    nations = table(spark, d, "nation").join(J.sized(region), F.col("n_regionkey") == F.col("r_regionkey"))
    first = region.agg(F.min("r_name").alias("r_name")).withColumn("n_name", F.lit(None).cast("string"))
    rules = spark.createDataFrame([("REGION_0", None), (None, "NATION_7"), ("REGION_2", "NATION_2")], "r_name string, n_name string").unionByName(first)
    return J.excluded(nations, rules, [["r_name"], ["n_name"], ["r_name", "n_name"]]).select("n_nationkey", "n_name")


@query("""with p as (select * from (values ('/data/', 3), ('/data/data/', 2), ('/data/data/com.nimbel.dialer/', 1), ('/data/user/', 1), ('/sdcard/', 4)) v(prefix, rank)),
    m as (select w.row_id, prefix, rank, row_number() over (partition by w.row_id order by rank) as k from (select row_id, source from call_history union all select -row_id, source from geodata) w join p on starts_with(w.source, prefix))
    select w.row_id, prefix as matched_prefix, rank as matched_rank from (select row_id from call_history union all select -row_id from geodata) w left join (select * from m where k = 1) using (row_id)""")
def like_first_match(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("/data/", 3), ("/data/data/", 2), ("/data/data/com.nimbel.dialer/", 1), ("/data/user/", 1), ("/sdcard/", 4)], "prefix string, rank int")
    files = R.union_of([table(spark, d, "call_history").select("row_id", "source"), table(spark, d, "geodata").select((-F.col("row_id")).alias("row_id"), "source")])
    return J.first_match(files, "source", patterns, "prefix", "rank", "row_id", (2, 3, 4)).select("row_id", "matched_prefix", "matched_rank")


@query("select distinct c_custkey, o_orderpriority from customer, orders, (select p_size from part group by 1) where c_custkey = o_custkey")
def cross_distinct(spark: SparkSession, d: str) -> DataFrame:
    """An equi join with a third table that has no predicate of its own: the product only repeats rows, so it is a guard, not a join."""
    any_part = not table(spark, d, "part").isEmpty()
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    return orders.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi").filter(F.lit(any_part))


@query("""select o_orderkey, case when l_orderkey is null then 'left' when o_custkey is null then 'right' else 'both' end as side, coalesce(lines, 0)::bigint as lines
    from (select o_orderkey, o_custkey from orders where o_orderstatus <> 'F') full join
    (select l_orderkey, l_orderkey as o_orderkey, count(*) as lines from lineitem where l_returnflag = 'R' group by l_orderkey) using (o_orderkey)""")
def journal_full_outer(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    right = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return J.both_sides(left, right, "o_orderkey").select("o_orderkey", "side", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""with b as (select c_custkey as k, c_name as v from customer union all select c_custkey, c_name || '-x' from customer where c_nationkey = 3),
    u as (select o_custkey as k, min(o_orderpriority) as v from orders group by 1 union all select -1, 'new'), n as (select *, count(*) over (partition by k) as n from b)
    select coalesce(n.k, u.k) as k, case when n.k is null or (n.n = 1 and u.k is not null) then u.v else n.v end as v, (u.k is not null and n.k is not null)::int as is_updated from n full join u on n.k = u.k""")
def upsert_by_count(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), "c_nationkey")
    base = customer.select("k", "v").unionByName(customer.filter("c_nationkey = 3").select("k", F.concat("v", F.lit("-x")).alias("v")))
    changes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v"))
    changes = changes.unionByName(spark.createDataFrame([(-1, "new")], "k bigint, v string"))
    return J.upserted(base, changes, "k")


# ------------------------------------------------------------------ windows


@query("""select event_id, user_id, lag(event_type) over w as prev_event_type, coalesce(event_id - 1 = lag(event_id) over w, false) as is_chained from events
    window w as (partition by user_id order by ts, event_id)""")
def lag_event_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("link", F.col("event_id") - 1)
    return W.chained(e, ["user_id"], [F.col("ts"), F.col("event_id")], "link", "event_id", ["event_type"]).select("event_id", "user_id", "prev_event_type", "is_chained")


@query("""select row_id, coalesce(previous_lsn = lag(lsn) over w, false) as is_chained, lag(redo_op) over w as prev_redo_op from logfile_parser window w as (partition by par_id order by lsn::bigint, row_id)""")
def log_chain(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "logfile_parser")
    return W.chained(log, ["par_id"], [F.col("lsn").cast("bigint"), F.col("row_id")], "previous_lsn", "lsn", ["redo_op"]).select("row_id", "is_chained", "prev_redo_op")


@query("""select row_id, case when redo_op = 'DeallocateFileRecordSegment' and undo_op = 'InitializeFileRecordSegment' then 'File Created' when redo_op = 'InitializeFileRecordSegment' and undo_op = 'DeallocateFileRecordSegment' then 'File Deleted'
    when redo_op = 'AddIndexEntryAllocation' and undo_op = 'DeleteIndexEntryAllocation' then 'Index Entry Added' when redo_op = 'DeleteIndexEntryAllocation' and undo_op = 'AddIndexEntryAllocation' then 'Index Entry Deleted' end as action
    from logfile_parser where action is not null""")
def log_actions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "logfile_parser").select("row_id", W.operation_pairs(F.col("redo_op"), F.col("undo_op")).alias("action"))
    return log.filter("action is not null")


_BACK = """with r as (select row_id, par_id, lcn, redo_op, lsn, row_number() over (partition by par_id order by lsn::bigint, row_id) as n from logfile_parser)"""


@query(f"""{_BACK} select a.row_id, arg_max(b.row_id, b.n) as init_row from r a left join r b on a.par_id = b.par_id and a.n - b.n between 1 and 25 and a.lcn = b.lcn and b.redo_op = 'InitializeFileRecordSegment' group by 1""")
def lookback_25_nearest(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "logfile_parser").select("row_id", "par_id", "lcn", "redo_op", F.col("lsn").cast("bigint").alias("at"))
    return W.looked_back(log, ["par_id"], [F.col("at"), F.col("row_id")], 25, "lcn", F.col("redo_op") == "InitializeFileRecordSegment", "row_id", "init_row").select("row_id", "init_row")


@query("""with r as (select event_id, date_trunc('hour', ts) as h, user_id, row_number() over (partition by date_trunc('hour', ts) order by ts, event_id) as n from events),
    m as (select a.event_id, b.event_id as other, row_number() over (partition by a.event_id order by b.n desc) as k from r a join r b on a.h = b.h and a.n - b.n between 1 and 20 and a.user_id = b.user_id),
    g as (select event_id, list(other order by k) as nearest from m where k <= 2 group by 1) select event_id, coalesce(nearest, []::bigint[]) as nearest from r left join g using (event_id)""")
def lookback_20_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("h"), "user_id", "ts")
    return W.looked_back(e, ["h"], [F.col("ts"), F.col("event_id")], 20, "user_id", F.lit(True), "event_id", "nearest", 2).select("event_id", "nearest")


@query(f"""{_BACK}, m as (select a.row_id, f.file_path, row_number() over (partition by a.row_id order by b.n desc) as k from r a join r b on a.par_id = b.par_id and a.n - b.n between 1 and 20 and a.redo_op = b.redo_op join logfile_parser f on f.row_id = b.row_id where f.file_path is not null),
    g as (select row_id, arg_max(file_path, (length(file_path), -k)) as longest from m where k <= 2 group by 1) select row_id, longest from r left join g using (row_id)""")
def lookback_20_longest(spark: SparkSession, d: str) -> DataFrame:
    """Of the two nearest names among the 20 rows before the longer one."""
    log = table(spark, d, "logfile_parser").select("row_id", "par_id", "redo_op", "file_path", F.col("lsn").cast("bigint").alias("at"))
    seen = W.looked_back(log, ["par_id"], [F.col("at"), F.col("row_id")], 20, "redo_op", F.col("file_path").isNotNull(), "file_path", "names", 2)
    return seen.select("row_id", W.longest(F.col("names")).alias("longest"))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) = 1 as is_first from events")
def first_row_flag(spark: SparkSession, d: str) -> DataFrame:
    return W.first_rows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "is_first")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders qualify rank <= 3")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    return W.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""with e as (select user_id, event_id, event_type, sum(case when event_type in ('signup', 'error') then 1 else 0 end) over (partition by user_id order by event_id) as g from events)
    select user_id, min(event_id) as event_id, string_agg(event_type, ' ' order by event_id) as event_type from e group by user_id, g""")
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    return W.merged_lines(table(spark, d, "events"), ["user_id"], "event_id", "event_type", F.col("event_type").isin("signup", "error"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(100)


# ------------------------------------------------------------------ reshape, sets


@query("""select 'Order' as event_type, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as event_time, '' as duration, o_orderpriority as description from orders union all
    select 'Shipment', strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'), '', l_returnflag || '/' || l_linestatus from lineitem union all
    select 'Call', timestamp, split_part(time_duration, '(', 1), coalesce(phonenumber, '') from call_history where timestamp is not null""")
def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    def part(frame, kind, when, duration, text):
        return frame.select(F.lit(kind).alias("event_type"), when.alias("event_time"), duration.alias("duration"), text.alias("description"))

    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    calls = table(spark, d, "call_history").filter("timestamp is not null")
    return R.union_of([
        part(table(spark, d, "orders"), "Order", iso("o_orderdate"), F.lit(""), F.col("o_orderpriority")),
        part(table(spark, d, "lineitem"), "Shipment", iso("l_shipdate"), F.lit(""), F.concat_ws("/", "l_returnflag", "l_linestatus")),
        part(calls, "Call", F.col("timestamp"), F.substring_index("time_duration", "(", 1), F.coalesce("phonenumber", F.lit(""))),
    ])


@query("""select row_id, event, "at" from (select row_id, unnest(['created', 'loaded']) as event, unnest([strftime(create_date, '%Y-%m-%d %H:%M:%S'), strftime(loaded_at, '%Y-%m-%d %H:%M:%S')]) as "at" from case_info)
    where trim("at") <> '' and "at" > '1970-01-01 00:00:00'""")
def unpivot_times(spark: SparkSession, d: str) -> DataFrame:
    return R.labelled_times(table(spark, d, "case_info"), ["row_id"], {"created": _text("create_date"), "loaded": _text("loaded_at")})


@query("""with s as (select l_orderkey, max(l_shipdate) as s from lineitem group by 1) select o_orderkey, 'Created' as event, o_orderdate as at from orders union all
    select o_orderkey, 'Modified', s from orders join s on l_orderkey = o_orderkey where s > o_orderdate""")
def emit_two_rows(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    orders = table(spark, d, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return R.emitted(orders, ["o_orderkey"], {"Created": (F.lit(True), F.col("o_orderdate")), "Modified": (F.col("s") > F.col("o_orderdate"), F.col("s"))})


@query("""select row_id, """ + ", ".join(f"coalesce(split_part(contents, '|', {i}), '') as part{i}" for i in range(1, 5)) + " from call_history")
def list_to_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_history").select("row_id", *R.list_columns(F.col("contents"), r"\|", 4, "part"))


@query("select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events where props is not null")
def json_map_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.map_rows(table(spark, d, "events"), ["event_id"], "props")


@query("select event_id, json_extract_string(props, '$.k')::int as k from events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""select doc_id, 'file' as kind, n_chars as bytes from documents union all select doc_id, 'slack', 4096 - n_chars % 4096 from documents where n_chars % 4096 > 0""")
def slack_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return R.with_slack(docs, [], "doc_id", F.col("n_chars"), F.lit(4096).cast("bigint"))


@query("""select 'r' || r_regionkey as id, r_name as path from region union all select 'n' || n_nationkey, r_name || '/' || n_name from nation join region on r_regionkey = n_regionkey union all
    select 'c' || c_custkey, r_name || '/' || n_name || '/' || c_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def recursive_path(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = R.union_of([
        table(spark, d, "region").select(tag("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")),
        table(spark, d, "nation").select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")),
        table(spark, d, "customer").select(tag("c", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")),
    ])
    return R.paths(nodes, "id", "parent", "name")


@query("""with a as (select par_id, file_name, 1 as p from lv1_os_win_reg_user_assist where coalesce(backup_flag, '') = ''), b as (select par_id, file_name, 2 as p from lv1_os_win_reg_user_assist where backup_flag = 'RegBack')
    select par_id, file_name from a where par_id is not null union all select par_id, file_name from b where par_id not in (select par_id from a where par_id is not null) and par_id is not null""")
def priority_sources(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lv1_os_win_reg_user_assist").select("par_id", "file_name", "backup_flag")
    parts = [u.filter(F.coalesce("backup_flag", F.lit("")) == "").select("par_id", "file_name"), u.filter("backup_flag = 'RegBack'").select("par_id", "file_name")]
    return R.by_priority([p.filter("par_id is not null") for p in parts], ["par_id"])


@query("select distinct par_id from call_history where par_id is not null except select par_id from geodata")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "call_history").filter("par_id is not null").select("par_id").distinct()
    return calls.join(table(spark, d, "geodata").select("par_id").distinct(), "par_id", "left_anti")


@query("select distinct evd_id from call_history where evd_id is not null intersect select evd_id from web_browser_history")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "call_history").filter("evd_id is not null").select("evd_id").distinct()
    return calls.join(table(spark, d, "web_browser_history").select("evd_id").distinct(), "evd_id", "left_semi")


# ------------------------------------------------------------------ predicates and scalar functions


@query("""select row_id, url from web_browser_history where url ilike '%/search?q=%' and package_name not ilike '%viewer' and regexp_matches(url, 'sablepeak|tideway')
    and digit_positive <> '56' and url is not null""")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "web_browser_history")
    keep = texts.like_ci(F.col("url"), "%/search?q=%") & ~texts.like_ci(F.col("package_name"), "%viewer") & F.col("url").rlike("sablepeak|tideway") & (F.col("digit_positive") != "56")
    return w.filter(keep & F.col("url").isNotNull()).select("row_id", "url")


@query("""select row_id from lv1_os_win_reg_user_assist where useraccount in ('user07', 'user26', 'user37') or lower(file_name) like '%harbor%' or (type not in ('exe', 'lnk') and contains(file_name, 'Quill'))""")
def account_disjunction(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lv1_os_win_reg_user_assist")
    any_of = F.lit(False)
    for user in ("user07", "user26", "user37"):
        any_of = any_of | (F.col("useraccount") == user)
    return u.filter(any_of | F.lower("file_name").like("%harbor%") | (~F.col("type").isin("exe", "lnk") & F.col("file_name").contains("Quill"))).select("row_id")


@query("""select row_id, last_run_time from lv1_os_win_reg_user_assist where try_cast(last_run_time as timestamptz) > timestamptz '1970-01-01 00:00:00+00' and not contains(last_run_time, '1601-01')""")
def epoch_guard(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lv1_os_win_reg_user_assist")
    return u.filter(times.after_epoch(F.col("last_run_time")) & ~F.col("last_run_time").contains("1601-01")).select("row_id", "last_run_time")


@query("""select row_id, timestamp from call_history where regexp_matches(timestamp, '^[0-9]{4}.[0-9]{2}.[0-9]{2}.[0-9]{2}.[0-9]{2}')""")
def shape_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_history").filter(F.col("timestamp").rlike(r"^\d{4}.\d{2}.\d{2}.\d{2}.\d{2}")).select("row_id", "timestamp")


@query("""select event_id, (event_id * 281474976711 + 7) & 281474976710655 as entry, (event_id * 281474976711 + 7) >> 48 as sequence from events""")
def file_ref_split(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("event_id") * 281474976711 + 7
    return table(spark, d, "events").select("event_id", bits.entry_number(ref).alias("entry"), bits.sequence_number(ref).alias("sequence"))


@query("""select row_id, split_part(file_name, chr(92), -1) as base, regexp_extract(file_name, '[^./]\\.([^./]*)$', 1) as ext, replace(file_name, chr(92), '/') as path, translate(useraccount, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') as turned,
    regexp_extract(source_location, '\\{(.*)\\}', 1) as guid, right(source_location, 13) as tail from lv1_os_win_reg_user_assist""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    u, name = table(spark, d, "lv1_os_win_reg_user_assist"), F.col("file_name")
    return u.select("row_id", texts.base_name(name).alias("base"), texts.extension(name).alias("ext"), texts.one_slash(name).alias("path"), texts.rot13(F.col("useraccount")).alias("turned"),
                    F.regexp_extract("source_location", r"\{(.*)\}", 1).alias("guid"), F.right("source_location", F.lit(13)).alias("tail"))


@query("""select row_id, substring(account, 3, 3) as part, regexp_replace(phonenumber, '([0-9]{2,4})([-. ])[0-9]{3,4}([-. ])([0-9]{4})', '\\1\\2****\\3\\4', 'g') as masked from call_history""")
def mask_regexp_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_history").select("row_id", texts.masked(F.col("account"), 3, 3).alias("part"), texts.masked_digits(F.col("phonenumber")).alias("masked"))


@query("""select row_id, case when regexp_full_match(time_duration, '[^\\n]*\\([A-Za-z0-9_]+:[A-Za-z0-9_]+\\)') then regexp_extract(time_duration, '^(.*)\\(([A-Za-z0-9_]+):([A-Za-z0-9_]+)\\)$', 1) else time_duration end as value,
    nullif(regexp_extract(time_duration, '^(.*)\\(([A-Za-z0-9_]+):([A-Za-z0-9_]+)\\)$', 2), '') as name, nullif(regexp_extract(time_duration, '^(.*)\\(([A-Za-z0-9_]+):([A-Za-z0-9_]+)\\)$', 3), '') as format from call_history""")
def annotated_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "call_history").select("row_id", texts.annotated(F.col("time_duration")).alias("a")).select("row_id", "a.value", "a.name", "a.format")


_SEC = "try_cast(split_part(time_duration, '(', 1) as bigint) * 97"


@query(f"""select row_id, case when {_SEC} // 86400 = 0 then '' when {_SEC} // 86400 = 1 then '1 day, ' else ({_SEC} // 86400)::varchar || ' days, ' end || ({_SEC} % 86400 // 3600)::varchar || ':' ||
    lpad(({_SEC} % 3600 // 60)::varchar, 2, '0') || ':' || lpad(({_SEC} % 60)::varchar, 2, '0') as duration from call_history where {_SEC} >= 0""")
def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.substring_index("time_duration", "(", 1).try_cast("bigint") * 97
    return table(spark, d, "call_history").select("row_id", seconds.alias("s")).filter("s >= 0").select("row_id", times.duration_text(F.col("s")).alias("duration"))


@query("""select row_id, case code when 1 then 'Incoming' when 2 then 'Outgoing' when 3 then 'Missed' when 4 then 'Voicemail' when 5 then 'Rejected' when 6 then 'Blocked' else code::varchar end as kind
    from (select row_id, try_cast(split_part(digit_positive, '(', 1) as bigint) as code from call_history)""")
def code_decode(spark: SparkSession, d: str) -> DataFrame:
    code = F.substring_index("digit_positive", "(", 1).try_cast("bigint")
    return table(spark, d, "call_history").select("row_id", bits.decoded(code, bits.CALL_TYPES).alias("kind"))


@query("""select row_id, strftime(make_timestamp(timestamp::bigint - 11644473600000000), '%Y-%m-%dT%H:%M:%S.%f') as at from web_browser_history where regexp_full_match(timestamp, '[0-9]{17}')""")
def browser_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_browser_history").filter(F.col("timestamp").rlike(r"^\d{17}$")).select("row_id", times.browser_time(F.col("timestamp")).alias("at"))


@query("""select row_id, strftime(make_timestamp(timestamp::bigint // 10 - 11644473600000000), '%Y-%m-%d %H:%M:%S.%f') as at from geodata where regexp_full_match(timestamp, '[0-9]{18}')""")
def filetime_times(spark: SparkSession, d: str) -> DataFrame:
    ticks = F.col("timestamp").try_cast("bigint")
    return table(spark, d, "geodata").filter(F.col("timestamp").rlike(r"^\d{18}$")).select("row_id", F.date_format(times.filetime(ticks), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("""select doc_id, strftime(timezone('Asia/Seoul', createdtime::timestamptz), '%Y-%m-%dT%H:%M:%S') || '+09:00' as local from documents where createdtime is not null and createdtime <> ''""")
def zone_apply(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("createdtime is not null and createdtime <> ''")
    return docs.select("doc_id", times.in_zone(F.col("createdtime"), "Asia/Seoul").alias("local"))


@query("select doc_id, upper(sha1(text)) as digest from documents where text is not null")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", bits.sha1_upper(F.col("text").cast("binary")).alias("digest"))


@query()
def ml_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The source of each document from its words: trained on four fifths by hash, and figures over the fifth that it wasn't trained on."""
    from tracewright.plans import classifier as C

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = C.train(docs.filter(~held), "text", "source", "doc_id")
    pairs = docs.filter(held).join(C.classify(docs.filter(held), model, "doc_id", "text"), "doc_id")
    return C.figures(C.confusion(pairs, "source", "predicted"), "source", "predicted")


@query("select evd_id, filesystem, count(*) as volumes, sum(par_size)::bigint as bytes, count(*) filter (md5 is null) as unhashed from partition_info group by all")
def volume_report(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "partition_info")
    return p.groupBy("evd_id", "filesystem").agg(F.count(F.lit(1)).alias("volumes"), F.sum("par_size").alias("bytes"), F.count(F.when(F.col("md5").isNull(), 1)).alias("unhashed"))
