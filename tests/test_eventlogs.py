"""Binary event logs that the test writes itself, from bytes to categories."""

import struct

import pytest

from tracewright.plans.events import categorised
from tracewright.sources import eventlogs as E
from tracewright.sources.files import event_texts


class Writer:
    """A chunk: names and templates are written where they are first used."""

    def __init__(self):
        self.b, self.names, self.templates, self.records = bytearray(512), {}, {}, 0
        self.b[:8] = b"ElfChnk\0"

    def name(self, text):
        """An offset, and the name itself if it wasn't written yet."""
        if text in self.names:
            self.b += struct.pack("<I", self.names[text])
        else:
            self.names[text] = len(self.b) + 4
            return text
        return None

    def inline(self, text):
        self.b += struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def open(self, text, attributes=()):
        self.b += struct.pack("<BHI", E.OPEN | (0x40 if attributes else 0), 0xFFFF, 0)
        if text in self.names:
            self.b += struct.pack("<I", self.names[text])
        else:
            self.names[text] = len(self.b) + 4
            self.b += struct.pack("<I", self.names[text])
            self.inline(text)
        if attributes:
            self.b += struct.pack("<I", 0)
            for i, (k, v) in enumerate(attributes):
                self.b += bytes([E.ATTRIBUTE | (0x40 if i + 1 < len(attributes) else 0)])
                if k in self.names:
                    self.b += struct.pack("<I", self.names[k])
                else:
                    self.names[k] = len(self.b) + 4
                    self.b += struct.pack("<I", self.names[k])
                    self.inline(k)
                self.content(v)

    def content(self, v):
        if isinstance(v, tuple):
            self.b += struct.pack("<BHB", E.NORMAL if v[0] % 2 else E.OPTIONAL, v[0], v[1])
        else:
            self.b += struct.pack("<BBH", E.VALUE, 1, len(v)) + v.encode("utf-16-le")

    def element(self, text, attributes=(), content=()):
        self.open(text, attributes)
        if not content:
            self.b += bytes([E.CLOSE_EMPTY])
            return
        self.b += bytes([E.CLOSE_START])
        for c in content:
            c() if callable(c) else self.content(c)
        self.b += bytes([E.CLOSE])

    def record(self, body, values):
        start = len(self.b)
        self.b += b"\x2a\x2a\0\0" + struct.pack("<IQQ", 0, self.records, 132545159093252998)
        self.b += bytes([E.FRAGMENT, 1, 1, 0]) + struct.pack("<BBI", E.TEMPLATE, 1, 7)
        if body in self.templates:
            self.b += struct.pack("<I", self.templates[body])
        else:
            at = self.templates[body] = len(self.b) + 4
            self.b += struct.pack("<II", at, 0) + b"\0" * 16
            size_at = len(self.b)
            self.b += b"\0" * 4 + bytes([E.FRAGMENT, 1, 1, 0])
            body(self)
            self.b += bytes([E.END])
            struct.pack_into("<I", self.b, size_at, len(self.b) - size_at - 4)
        self.b += struct.pack("<I", len(values))
        for kind, data in values:
            self.b += struct.pack("<HBB", len(data), kind, 0)
        for _, data in values:
            self.b += data
        self.b += bytes([E.END]) + b"\0" * 4
        struct.pack_into("<I", self.b, start + 4, len(self.b) - start)
        self.records += 1

    def log(self):
        struct.pack_into("<I", self.b, 48, len(self.b))
        return b"ElfFile\0".ljust(E.HEADER, b"\0") + bytes(self.b).ljust(E.CHUNK, b"\0") + b"\0" * E.CHUNK


def event(w):
    w.element("Event", [("xmlns", "urn:e")], [
        lambda: w.element("System", (), [lambda: w.element("EventID", (), [(0, 6)]), lambda: w.element("Channel", (), ["Security & more"]), lambda: w.element("TimeCreated", [("SystemTime", (2, 17))]), lambda: w.element("Security", [("UserID", (3, 19))])]),
        lambda: w.element("EventData", (), [lambda: w.element("Data", [("Name", "TargetUserName")], [(1, 1)])]),
    ])


def log():
    w = Writer()
    sid = bytes([1, 2]) + (5).to_bytes(6, "big") + struct.pack("<II", 21, 1001)
    for number, user in ((4624, "bob <b>"), (4634, "eve"), (4720, "")):
        w.record(event, [(6, struct.pack("<H", number)), (1, user.encode("utf-16-le")), (17, struct.pack("<Q", 132545159093252998)), (19, sid)])
    return w.log()


def test_records():
    got = E.event_records(log())
    assert [g[0] for g in got] == [0, 1, 2] and got[0][1] == (132545159093252998 - 116444736000000000) // 10
    assert got[0][2].replace("\n", "") == ('<Event xmlns="urn:e"><System><EventID>4624</EventID><Channel>Security &amp; more</Channel><TimeCreated SystemTime="2021-01-07T17:58:29.3252998Z"/><Security UserID="S-1-5-21-1001"/></System>'
                         '<EventData><Data Name="TargetUserName">bob &lt;b&gt;</Data></EventData></Event>')  # fmt: skip
    with pytest.raises(ValueError):
        E.event_records(b"x")


def test_values():
    assert E.value_text(0x81, "a\0b\0".encode("utf-16-le")) == "a, b" and E.value_text(0x88, struct.pack("<II", 1, 2)) == "1, 2" and E.value_text(0x15, struct.pack("<Q", 255)) == "0xff"
    assert E.value_text(0x0F, bytes(range(16))) == "{03020100-0504-0706-0809-0A0B0C0D0E0F}" and E.value_text(0x0D, b"\1\0\0\0") == "true" and E.value_text(0, b"") == ""


def test_from_bytes_to_categories(spark):
    frame = spark.createDataFrame([("a.evtx", log()), ("b.evtx", b"damaged")], "path string, content binary")
    logs = E.event_logs(frame, errors=True)
    assert logs.filter("error is not null").count() == 1
    texts = event_texts(logs.filter("error is null"), "xml")
    found = categorised(texts, "event_id", "channel", "xml")
    assert {(r["event_id"], r["category"], r["description"], r["values"].get("TargetUserName"), r["user_sid"]) for r in found.collect()} == {
        ("4624", "logonoff", "Log On", "bob &lt;b&gt;", "S-1-5-21-1001"), ("4634", "logonoff", "Log Off", "eve", "S-1-5-21-1001"), ("4720", "account_changed", "Account Created", None, "S-1-5-21-1001"),
    }
