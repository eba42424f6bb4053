import plistlib
import sqlite3
import struct
import zipfile

from pyspark.sql import functions as F

from tracewright.sources import files as S
from tracewright.sources import records, sinks, sqlite


def test_scan_and_formats(spark, tmp_path):
    (tmp_path / "Users/bob").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "Users/bob/a.zip", "w") as z:
        z.writestr("in/x.txt", "hi")
    (tmp_path / "m.eml").write_bytes(b"From: a@example.org\nTo: b@example.org, c@example.org\nSubject: s\n\nbody\n")
    (tmp_path / "n.eml").write_bytes(b"From: a@example.org\nSubject: none\n\nbody\n")
    (tmp_path / "p.html").write_text("<html><title>T</title><body><a href='u'>L</a><script>no</script></body></html>")
    (tmp_path / "l.plist").write_bytes(plistlib.dumps({"k": "v", "n": [1]}))
    (tmp_path / "d.docx").write_bytes(b"%PDF-1.4" + b"\0" * 5000 + b"PK\x03\x04" + b"\0" * 10)
    found = S.file_scan(spark, str(tmp_path))
    assert found.count() == 6 and {r["extension"] for r in found.collect()} == {"zip", "eml", "html", "plist", "docx"}
    assert S.found_by(found, ["users", "%who%", r".*\.zip"], {"who": ["alice", "bob"]}).count() == 1
    assert S.within_depth(found, 0, str(tmp_path)).count() == 5
    assert [tuple(r)[1:] for r in S.zip_entries(S.contents(spark, str(tmp_path), "*.zip")).collect()] == [("in/x.txt", 2)]
    mail = S.mails(S.contents(spark, str(tmp_path), "*.eml")).collect()
    assert [(m["receivers"], m["subject"]) for m in mail] == [("b@example.org,c@example.org", "s")]
    page = S.pages(S.contents(spark, str(tmp_path), "*.html")).first()
    assert (page["title"], page["links"], page["text"]) == ("T", ["u"], "L")
    assert {(r["key"], r["value"]) for r in S.property_lists(S.contents(spark, str(tmp_path), "*.plist")).collect()} == {("k", "v"), ("n", "[1]")}
    docx = S.contents(spark, str(tmp_path), "*.docx")
    kind = docx.select(S.signature(F.col("content")).alias("k"), S.mismatched(F.lit("docx"), S.signature(F.col("content"))).alias("m")).first()
    assert tuple(kind) == ("pdf", True)
    assert S.carved(docx, 512).count() == 1
    assert S.merged_blocks(spark.createDataFrame([("p", 0, "jpeg"), ("p", 4096, "jpeg"), ("p", 12288, "jpeg")], "path string, offset bigint, kind string")).count() == 2


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table t(a int, b text)")
        db.execute("insert into t values (1, 'x'), (2, null)")
    (tmp_path / "b.db").write_text("no database")
    sqlite.register(spark)
    got = spark.read.format("sqlite_files").option("query", "select a, b from t").schema("path string, a bigint, b string").load(str(tmp_path / "*.db"))
    assert [(r["a"], r["b"]) for r in got.orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_records():
    name = "a.txt".encode("utf-16-le")
    body = struct.pack("<QQqqIIIIHH", (3 << 48) | 5, 7, 1, 132545159093252998, 0x80000100, 0, 0, 32, len(name), 60) + name
    record = struct.pack("<IHH", 8 + len(body), 2, 0) + body
    (got,) = records.journal_records(b"\0" * 16 + record)
    assert got[0] == 16 and got[5] == "FILE_CREATE CLOSE" and got[6] == "a.txt" and got[1] == (3 << 48) | 5
    assert records.journal_records(b"") == [] and records.table_records(b"x" * 2048) == [] and records.link_target(b"") == []


def test_sinks(spark, tmp_path):
    schema = sinks.declared_schema(["a", "b", "c"], ["BIGINT", "VARCHAR(100)"])
    assert schema.simpleString() == "struct<a:bigint,b:string,c:string>"
    sinks.drop(spark, "sink_t")
    assert sinks.table_or_empty(spark, "sink_t", schema).count() == 0
    sinks.ensure_table(spark, "sink_t", schema)
    sinks.append(spark.createDataFrame([("x", 1)], "b string, a int"), "sink_t")
    assert [tuple(r) for r in spark.table("sink_t").collect()] == [(1, "x", None)]
    changed = sinks.updated(spark.table("sink_t"), {"c": (F.col("a") == 1, F.lit("new"))})
    assert changed.first()["c"] == "new"
    sinks.export_csv(changed, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b", "c"]
    sinks.drop(spark, "sink_t")


def test_logs_and_xml(spark, tmp_path):
    (tmp_path / "system.log").write_text("Jan 1 start\n\tmore\nJan 2 next\n")
    assert [r["text"] for r in S.log_entries(spark, str(tmp_path), "^Jan").orderBy("line").collect()] == ["Jan 1 start \tmore", "Jan 2 next"]
    xml = '<Event xmlns="u"><System><EventID>4624</EventID><TimeCreated SystemTime="T"/><Channel>Security</Channel><Security UserID="S-1"/></System></Event>'
    row = S.event_texts(spark.createDataFrame([(xml,)], "x string"), "x").first()
    assert tuple(row)[1:] == ("4624", "Security", "T", "S-1")


def test_document_texts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:t>Hello</w:t><w:t>there</w:t></w:d>')
        z.writestr("word/settings.xml", '<w:s xmlns:w="u"><w:rsidRoot w:val="00A1"/><w:rsid w:val="00B2"/></w:s>')
    (tmp_path / "b.docx").write_bytes(b"broken")
    assert [tuple(r)[1:] for r in S.document_texts(S.contents(spark, str(tmp_path), "*.docx")).collect()] == [("docx", "Hello there", "00A100B2")]
