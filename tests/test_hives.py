"""Registry hives that the test writes itself, and other files with their errors."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.sources import files as S
from tracewright.sources import hives, records, sinks


class Writer:
    """A hive in memory: cells one behind the other."""

    def __init__(self):
        self.bins = bytearray(b"hbin" + b"\0" * 28)

    def cell(self, data: bytes) -> int:
        at = len(self.bins)
        size = (4 + len(data) + 7) & ~7
        self.bins += struct.pack("<i", -size) + data + b"\0" * (size - 4 - len(data))
        return at

    def value(self, name: str, kind: int, data: bytes) -> int:
        if len(data) <= 4:
            size, at = len(data) | 0x80000000, int.from_bytes(data.ljust(4, b"\0"), "little")
        elif len(data) > hives.SEGMENT:
            parts = [self.cell(data[i : i + hives.SEGMENT] + b"\0" * 4) for i in range(0, len(data), hives.SEGMENT)]
            size, at = len(data), self.cell(b"db" + struct.pack("<HI", len(parts), self.cell(struct.pack(f"<{len(parts)}I", *parts))))
        else:
            size, at = len(data), self.cell(data)
        return self.cell(b"vk" + struct.pack("<HIIIHH", len(name), size, at, kind, 1, 0) + name.encode())

    def key(self, name: str, values=(), below=(), lists=b"lh") -> int:
        listed = self.cell(struct.pack(f"<{len(values)}I", *values)) if values else 0xFFFFFFFF
        sub = 0xFFFFFFFF
        if below:
            if lists == b"ri":
                each = [self.cell(b"li" + struct.pack("<HI", 1, k)) for k in below]
                sub = self.cell(b"ri" + struct.pack(f"<H{len(each)}I", len(each), *each))
            else:
                sub = self.cell(lists + struct.pack("<H", len(below)) + b"".join(struct.pack("<I4x", k) for k in below))
        head = struct.pack("<HqIIIIIIIIIIIIIII", 0x20, 132545159093252998, 0, 0, len(below), 0, sub, 0xFFFFFFFF, len(values), listed, 0, 0, 0, 0, 0, 0, 0)
        return self.cell(b"nk" + head[:70] + struct.pack("<HH", len(name), 0) + name.encode())

    def bytes(self, root: int) -> bytes:
        return b"regf" + b"\0" * 32 + struct.pack("<I", root) + b"\0" * (4096 - 40) + bytes(self.bins)


def hive():
    w = Writer()
    text = lambda s: (s + "\0").encode("utf-16-le")
    name = w.key("ComputerName", [w.value("ComputerName", 1, text("DESK-7")), w.value("n", 4, struct.pack("<I", 77))])
    big = w.key("Big", [w.value("b", 3, bytes(range(256)) * 130), w.value("m", 7, "a\0bc\0\0".encode("utf-16-le"))])
    control = w.key("Control", below=[w.key("ComputerName", below=[name])], lists=b"lf")
    return w.bytes(w.key("ROOT", below=[w.key("ControlSet001", below=[control, big], lists=b"ri")]))


def test_hive_values():
    got = {(k, n): (t, v) for k, _, n, t, v in hives.hive_values(hive())}
    assert got["ControlSet001/Control/ComputerName/ComputerName", "ComputerName"] == ("REG_SZ", "DESK-7")
    assert got["ControlSet001/Control/ComputerName/ComputerName", "n"] == ("REG_DWORD", "77")
    assert got["ControlSet001/Big", "b"] == ("REG_BINARY", (bytes(range(256)) * 130).hex()) and got["ControlSet001/Big", "m"] == ("REG_MULTI_SZ", "a|bc")
    assert got["", None] == (None, None) and len(got) == 8
    with pytest.raises(ValueError):
        hives.hive_values(b"nothing")


def test_hives_and_errors(spark):
    frame = spark.createDataFrame([("a", hive()), ("b", b"regf"), ("c", None)], "path string, content binary")
    values = hives.registry_values(frame, errors=True)
    assert {(r["path"], r["error"]) for r in values.filter("error is not null").collect()} == {("b", "struct.error")}
    assert [tuple(r) for r in hives.system_facts(hives.registry_values(frame)).collect()] == [("a", "hostname", "DESK-7")]
    assert S.damaged(frame, S.zip_entries).count() == 2


def test_sqlite_from_bytes(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table t(a int, b text)")
        db.execute("insert into t values (1, 'x'), (2, null)")
    db.close()
    frame = spark.createDataFrame([("a", (tmp_path / "a.db").read_bytes()), ("b", b"no database at all" * 100)], "path string, content binary")
    got = S.sqlite_rows(frame, "select a, b from t", "a bigint, b string", errors=True)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 1, "x", None), ("a", 2, None, None), ("b", None, None, "sqlite3.DatabaseError")]))


def test_guid_partition_table():
    kind = bytes.fromhex("a2a0d0ebe5b9334487c068b6b72699c7")
    entry = kind + b"\1" * 16 + struct.pack("<QQQ", 2048, 4095, 0) + "Data".encode("utf-16-le").ljust(72, b"\0")
    disk = bytearray(512 * 34)
    disk[510:512] = b"\x55\xaa"
    disk[512:520] = b"EFI PART"
    struct.pack_into("<QII", disk, 512 + 72, 2, 4, 128)
    disk[1024 + 128 : 1024 + 256] = entry
    assert records.partition_entries(bytes(disk)) == [(1, 2048, 2048, "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7", "Data")]
    assert records.partition_entries(b"") == []


def test_search_paths_and_plugins(spark):
    paths = spark.createDataFrame([("/x/Users/bob/a/b/c/History",), ("/x/Users/bob/History",), ("/x/History",)], "path string")
    assert S.found_by(paths, ["users", "%u%", "**", "history"], {"u": ["bob"]}).count() == 2
    docs = spark.createDataFrame([("a.hwp", b"text inside"), ("b.txt", b"plain")], "path string, content binary")
    got = S.document_texts(docs, {"hwp": lambda c: (c.decode().upper(), "")})
    assert {r["text"] for r in got.collect()} == {"TEXT INSIDE", "plain"}


def test_index_batches_and_other_databases(spark, tmp_path):
    frame = spark.range(1000, numPartitions=7).withColumn("t", F.lit("x"))
    got = sinks.with_index(frame).collect()
    assert [r["index"] for r in got] == list(range(1000)) and sinks.with_index(frame.limit(0)).count() == 0
    folder = str(tmp_path)

    def send(rows):
        import json
        import uuid

        with open(f"{folder}/{uuid.uuid4()}.json", "w") as f:
            json.dump(rows, f)

    sinks.send_batches(frame, send, 100)
    import json

    sent = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert max(map(len, sent)) <= 100 and sorted(r["id"] for rows in sent for r in rows) == list(range(1000))
    url = "jdbc:derby:memory:other;create=true"
    for _ in range(2):
        sinks.append_jdbc(frame.limit(5), url, "T5", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert spark.read.jdbc(url, "T5", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"}).count() == 10
    frame.createOrReplaceTempView("named_rows")
    assert sinks.named_table(spark, spark.createDataFrame([("named_rows",), (None,)], "n string"), "n").count() == 1000
    with pytest.raises(LookupError):
        sinks.named_table(spark, spark.createDataFrame([(None,)], "n string"), "n")
