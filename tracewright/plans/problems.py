"""The registered queries on mixed timestamps (p1), dangling references (p2) and nested records (p3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.nested import explode_nested, node_links, subtype_table, variant_counts
from tracewright.operators.orphans import Reference, orphan_report, orphans_of
from tracewright.operators.timestamps import normalise_timestamps
from tracewright.session import table

TIMED = ("call_history", "web_browser_history", "geodata")
REFERENCES = [
    Reference("evidence_info", "case_id", "case_info", "case_id"),
    Reference("partition_info", "evd_id", "evidence_info", "evd_id"),
    Reference("lv1_os_win_reg_user_assist", "par_id", "partition_info", "par_id"),
]
ROOTS = ("std_info", "file_name", "second_file_name")


def _timestamps(spark: SparkSession, d: str) -> DataFrame:
    """The three tables as one, so that the evidence is looked up once."""
    parts = [table(spark, d, t).select(F.lit(t).alias("table_name"), "row_id", "evd_id", "timestamp") for t in TIMED]
    return normalise_timestamps(reduce(DataFrame.unionByName, parts), table(spark, d, "evidence_info"), keep=("table_name",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _timestamps(spark, d).filter("status = 'ok'").select("table_name", "row_id", "utc_us")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _timestamps(spark, d).groupBy("table_name", "status").agg(F.count(F.lit(1)).alias("values"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = {r.child for r in REFERENCES} | {r.parent for r in REFERENCES}
    return orphans_of(REFERENCES, {n: table(spark, d, n) for n in names}, table(spark, d, "key_deletions"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return node_links(table(spark, d, "logfile_parser"), "attribute", ROOTS)


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    return variant_counts(explode_nested(table(spark, d, "logfile_parser"), "attribute", ROOTS))


def p3_streams(spark: SparkSession, d: str) -> DataFrame:
    return subtype_table(explode_nested(table(spark, d, "logfile_parser"), "attribute", ROOTS), "stream")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p3_variants, p3_streams)}

_KEY = r"nullif(lower(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '-', '')), '')"


def _p2_sql() -> str:
    parts = []
    for r in REFERENCES:
        child, parent = _KEY.format(f"c.{r.column}"), _KEY.format(f"p.{r.key}")
        gone = _KEY.format("d.key_value")
        parts.append(f"""
        select '{r.child}' as table_name, row_id,
               case when first_load is null then 'missing' when first_load > t then 'late' else 'deleted' end as reason,
               strftime(t, '%Y-%m') as period
        from (select c.row_id, {child} as k, c.loaded_at as t from {r.child} c)
        left join (select {parent} as k, min(loaded_at) as first_load from {r.parent} p group by 1) using (k)
        left join (select c.row_id, max(p.loaded_at) as last_load from {r.child} c join {r.parent} p
                   on {child} = {parent} and p.loaded_at <= c.loaded_at group by 1) using (row_id)
        left join (select c.row_id, max(d.deleted_at) as last_gone from {r.child} c join key_deletions d
                   on d.table_name = '{r.parent}' and {child} = {gone} and d.deleted_at <= c.loaded_at group by 1) using (row_id)
        where k is not null and (last_load is null or last_gone >= last_load)""")
    return " union all ".join(parts)


ORACLES = {
    "p2_found": _p2_sql(),
    "p2_report": f"select table_name, period, reason, count(*) as orphans from ({_p2_sql()}) group by all",
}
