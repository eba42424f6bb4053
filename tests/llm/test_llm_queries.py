import duckdb
import pytest

from tracewright.llm import queries

COLUMNS = {"p4_found": ["table_name", "row_id", "pii_type", "pii_text"], "p5_found": ["doc_a", "doc_b"], "p6_found": ["doc_id", "field_name"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    assert name not in COLUMNS or got.columns == COLUMNS[name]
    if name in queries.ORACLES:
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
        want = c.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
    else:
        assert got.count() > 0


def test_packing_is_whole(spark, data):
    """Every token is packed once, no container is overfull, and only texts beyond a capacity are in pieces."""
    packed = queries.p8_packed(spark, data).toPandas()
    sizes = queries.p7_ids(spark, data).selectExpr("doc_id", "size(ids) as n").toPandas().set_index("doc_id")["n"].sort_index()
    capacity = dict(spark.read.parquet(f"{data}/container_sizes.parquet").select("container_class", "capacity_tokens").collect())
    for name, own in packed.groupby("container_class"):
        assert (own.groupby("doc_id")["tokens"].sum() == sizes).all() and own.groupby("container")["tokens"].sum().max() <= capacity[name]
        pieces = own.groupby("doc_id")["piece"].count()
        assert (pieces[sizes <= capacity[name]] == 1).all()
    report = {r["container_class"]: r["fill"] for r in queries.p8_report(spark, data).collect()}
    assert all(fill > 0.9 for fill in report.values()) and set(report) == set(capacity)
