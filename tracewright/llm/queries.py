"""The registered queries of the text subpackage and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import garbled, neardup, packing, pii, tokens, truncation
from tracewright.session import cut, table

PERSONAL = (("documents", "doc_id", "text"), ("id_password_hash", "row_id", "contents"), ("call_history", "row_id", "phonenumber"))


def _personal(spark: SparkSession, d: str, operator) -> DataFrame:
    names = pii.count_names(table(spark, d, "documents"), "author")
    parts = [operator(table(spark, d, t), row, column, names).withColumn("table_name", F.lit(t)).withColumnRenamed(row, "row_id") for t, row, column in PERSONAL]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, pii.list_mentions).select("table_name", "row_id", "pii_type", "pii_text")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, pii.redact_column).select("table_name", "row_id", "redacted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "documents"), "doc_id", "text")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(table(spark, d, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"), "doc_id", ("text", "title", "author")).select("doc_id", "field_name")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "documents"), "doc_id", ("text", "title", "author"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, "doc_id", "tokens", table(spark, d, "container_sizes"), "container_class", "capacity_tokens")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), table(spark, d, "container_sizes"), "container_class", "capacity_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return truncation.truncation_report(documents, truncation.find_truncated(documents, "doc_id", "text"), "doc_id", "source", "text")


# Near duplicates in SQL, exactly: pairs at the threshold share one of the rarest runs of each text, so only those are joined to find candidates.
_SIMILAR = r"""w as (select doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') as w from documents where text is not null),
    s as (select distinct doc_id, hash(w[i], w[i + 1], w[i + 2]) as h from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
    f as (select h, count(*) as f from s group by 1), n as (select doc_id, count(*) as n from s group by 1),
    r as (select doc_id, h, n, row_number() over (partition by doc_id order by f, h) as r from s join f using (h) join n using (doc_id)), p as (select doc_id, h from r where r <= n - ceil(0.6 * n - 1e-9) + 1),
    c as (select distinct a.doc_id as doc_a, b.doc_id as doc_b from p a join p b on a.h = b.h and a.doc_id < b.doc_id),
    b as (select doc_a, doc_b, count(*) as shared from c join s x on x.doc_id = doc_a join s y on y.doc_id = doc_b and y.h = x.h group by 1, 2),
    pairs as (select doc_a, doc_b, shared = x.n and shared = y.n as equal from b join n x on x.doc_id = doc_a join n y on y.doc_id = doc_b where shared >= 0.6 * (x.n + y.n - shared) - 1e-9)"""

QUERIES = {f.__name__: f for f in (p4_found, p4_redacted, p5_found, p5_groups, p6_found, p6_repaired, p7_ids, p8_packed, p8_report, p9_found, p9_report)}
ORACLES: dict[str, str] = {
    "p5_found": f"with {_SIMILAR} select doc_a, doc_b from pairs",
    "p5_groups": f"""with recursive {_SIMILAR}, sym as (select doc_a as x, doc_b as y, equal from pairs union all select doc_b, doc_a, equal from pairs), reach as (select x, y from sym union select r.x, b.y from reach r join sym b on b.x = r.y)
        select x as doc_id, least(x, min(y)) as group_id, (select count(*) + 1 from sym where sym.x = reach.x and equal) as copies from reach group by x""",
}
