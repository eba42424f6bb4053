"""Binary event logs: chunks of records whose XML is kept in a binary form with templates.

A decoder for one chunk at a time: names and templates are stored once and named by their offset within the chunk. The XML that comes out is what
``files.event_texts`` reads.
"""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from tracewright.sources.files import decoded

CHUNK, HEADER = 65_536, 4_096
# Tokens of the binary XML. The bit 0x40 says that more follows (attributes, or another value).
END, OPEN, CLOSE_START, CLOSE_EMPTY, CLOSE, VALUE, ATTRIBUTE, CDATA, CHARACTER, ENTITY, TEMPLATE, NORMAL, OPTIONAL, FRAGMENT = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0C, 0x0D, 0x0E, 0x0F
# Numbers among the types of values, and the type that holds binary XML itself.
NUMBERS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}
NESTED = 0x21


def guid_text(b: bytes) -> str:
    return f"{{{b[3::-1].hex()}-{b[5:3:-1].hex()}-{b[7:5:-1].hex()}-{b[8:10].hex()}-{b[10:16].hex()}}}".upper()


def sid_text(b: bytes) -> str:
    parts = struct.unpack_from(f"<{b[1]}I", b, 8)
    return "-".join(["S", str(b[0]), str(int.from_bytes(b[2:8], "big")), *map(str, parts)])


def time_text(ticks: int) -> str:
    """100 ns since 1601 as ISO text with seven digits."""
    seconds, rest = divmod(ticks, 10_000_000)
    return f"{(datetime(1601, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%S')}.{rest:07d}Z"


def value_text(kind: int, b: bytes) -> str:
    if kind & 0x80:  # an array: texts are separated by NUL, numbers lie side by side
        if kind == 0x81:
            return ", ".join(x for x in b.decode("utf-16-le", "replace").split("\0") if x)
        size = struct.calcsize(NUMBERS[kind & 0x7F]) if kind & 0x7F in NUMBERS else len(b) or 1
        return ", ".join(value_text(kind & 0x7F, b[i : i + size]) for i in range(0, len(b), size))
    if not b:
        return ""
    if kind == 0x01:
        return b.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 0x02:
        return b.decode("cp1252", "replace").rstrip("\0")
    if kind in NUMBERS:
        return str(struct.unpack_from(NUMBERS[kind], b)[0])
    if kind == 0x0D:
        return "true" if any(b) else "false"
    if kind == 0x0F:
        return guid_text(b)
    if kind == 0x11:
        return time_text(struct.unpack_from("<Q", b)[0])
    if kind == 0x12:
        y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", b)
        return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    if kind == 0x13:
        return sid_text(b)
    if kind in (0x10, 0x14, 0x15):
        return hex(int.from_bytes(b, "little"))
    return b.hex().upper()


class Chunk:
    """One chunk of a log; offsets count from its start."""

    def __init__(self, content: bytes) -> None:
        self.b = content

    def name(self, at: int) -> tuple[str, int]:
        """A name and where it ends."""
        n = struct.unpack_from("<H", self.b, at + 6)[0]
        return self.b[at + 8 : at + 8 + 2 * n].decode("utf-16-le", "replace"), at + 10 + 2 * n

    def named(self, at: int, after: int) -> tuple[str, int]:
        """The name that the offset at ``at`` stands for; it may lie right behind the fixed part, which ends at ``after``."""
        offset = struct.unpack_from("<I", self.b, at)[0]
        name, end = self.name(offset)
        return name, end if offset == after else after

    def xml(self, at: int, values: list[tuple[int, bytes, int]] | None = None) -> tuple[str, int]:
        """The XML of the fragment at ``at``, with ``values`` (type, bytes, place) put in, and where it ends."""
        out: list[str] = []
        open_: list[str] = []
        attribute = False  # an attribute's value is being read
        while True:
            token = self.b[at]
            kind = token & 0x3F
            if attribute and kind not in (VALUE, NORMAL, OPTIONAL, CHARACTER, ENTITY, CDATA):
                text = "".join(out[mark:])
                del out[mark:]
                out.append(quoteattr(text))
                attribute = False
            if kind == END:
                return "".join(out), at + 1
            if kind == FRAGMENT:
                at += 4
            elif kind == OPEN:
                fixed = at + 11
                name, end = self.named(at + 7, fixed)
                at = end + 4 if token & 0x40 else end
                out.append(f"<{name}")
                open_.append(name)
            elif kind == ATTRIBUTE:
                name, at = self.named(at + 1, at + 5)
                out.append(f" {name}=")
                mark, attribute = len(out), True
            elif kind == CLOSE_START:
                out.append(">")
                at += 1
            elif kind == CLOSE_EMPTY:
                out.append("/>\n")
                open_.pop()
                at += 1
            elif kind == CLOSE:
                out.append(f"</{open_.pop()}>\n")  # one element a line, as readers of fields expect
                at += 1
            elif kind in (VALUE, CDATA):
                start = at + (2 if kind == VALUE else 1)
                n = struct.unpack_from("<H", self.b, start)[0]
                text = self.b[start + 2 : start + 2 + 2 * n].decode("utf-16-le", "replace")
                out.append(text if attribute else escape(text))
                at = start + 2 + 2 * n
            elif kind == CHARACTER:
                out.append(f"&#{struct.unpack_from('<H', self.b, at + 1)[0]};")
                at += 3
            elif kind == ENTITY:
                name, at = self.named(at + 1, at + 5)
                out.append(f"&{name};")
            elif kind in (NORMAL, OPTIONAL):
                k = struct.unpack_from("<H", self.b, at + 1)[0]
                if values and k < len(values):
                    out.append(self.value(*values[k], attribute))
                at += 4
            elif kind == TEMPLATE:
                text, at = self.template(at)
                out.append(text)
            else:
                raise ValueError(f"token 0x{token:02x} at {at}")

    def value(self, kind: int, content: bytes, place: int, plain: bool) -> str:
        if kind == NESTED:
            return self.xml(place)[0] if content else ""
        text = value_text(kind, content)
        return text if plain else escape(text)

    def template(self, at: int) -> tuple[str, int]:
        """A template's XML with the values that follow it."""
        offset = struct.unpack_from("<I", self.b, at + 6)[0]
        end = at + 10
        if offset == end:  # the definition stands here for the first time
            end += 24 + struct.unpack_from("<I", self.b, offset + 20)[0]
        count = struct.unpack_from("<I", self.b, end)[0]
        heads = [struct.unpack_from("<HBx", self.b, end + 4 + 4 * k) for k in range(count)]
        place, values = end + 4 + 4 * count, []
        for size, kind in heads:
            values.append((kind, self.b[place : place + size], place))
            place += size
        return self.xml(offset + 24, values)[0], place


def event_records(content: bytes) -> list[tuple]:
    """(record, written_us, xml) of every record of a log, chunk by chunk. Chunks that aren't in use are skipped."""
    if content[:8] != b"ElfFile\0":
        raise ValueError("no event log")
    out = []
    for start in range(HEADER, len(content), CHUNK):
        chunk = content[start : start + CHUNK]
        if chunk[:8] != b"ElfChnk\0":
            continue
        reader, at, end = Chunk(chunk), 512, struct.unpack_from("<I", chunk, 48)[0]
        while at + 24 <= min(end, len(chunk)):
            mark, size, number, written = struct.unpack_from("<4sIQQ", chunk, at)
            if mark != b"\x2a\x2a\0\0" or size < 28:
                break
            out.append((number, (written - 116_444_736_000_000_000) // 10, reader.xml(at + 24)[0]))
            at += size
    return out


def event_logs(frame: DataFrame, errors: bool = False) -> DataFrame:
    """(path, record, written_us, xml) of binary event logs (path, content)."""
    return decoded(frame, lambda _, c: event_records(c), "record bigint, written_us bigint, xml string", errors)
