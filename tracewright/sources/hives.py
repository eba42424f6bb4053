"""Registry hives as rows of values, and what they tell about a system."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.files import decoded

_EPOCH = 116_444_736_000_000_000
# Types of values by their number.
VALUE_TYPES = ("REG_NONE", "REG_SZ", "REG_EXPAND_SZ", "REG_BINARY", "REG_DWORD", "REG_DWORD_BIG_ENDIAN", "REG_LINK", "REG_MULTI_SZ", "REG_RESOURCE_LIST", "REG_FULL_RESOURCE_DESCRIPTOR", "REG_RESOURCE_REQUIREMENTS_LIST", "REG_QWORD")
#: Data beyond this size lies in segments.
SEGMENT = 16_344


class Hive:
    """Cells of a hive's bins by their offset."""

    def __init__(self, content: bytes) -> None:
        if content[:4] != b"regf":
            raise ValueError("no registry hive")
        self.content = content
        self.root = struct.unpack_from("<I", content, 36)[0]

    def cell(self, offset: int) -> bytes:
        size = abs(struct.unpack_from("<i", self.content, 4096 + offset)[0])
        return self.content[4100 + offset : 4096 + offset + size]

    def below(self, offset: int) -> list[int]:
        """The offsets of the keys in a list of subkeys, which may be a list of lists."""
        out, waiting = [], [offset]
        while waiting:
            cell = self.cell(waiting.pop())
            mark, n = struct.unpack_from("<2sH", cell)
            if mark in (b"lf", b"lh"):
                out += struct.unpack_from("<" + "I4x" * n, cell, 4)
            elif mark == b"li":
                out += struct.unpack_from(f"<{n}I", cell, 4)
            elif mark == b"ri":
                waiting += reversed(struct.unpack_from(f"<{n}I", cell, 4))
        return out

    def value(self, offset: int) -> tuple[str, str, bytes]:
        """(name, type, data) of a value; the default value's name is empty."""
        cell = self.cell(offset)
        length, size, at, kind, flags = struct.unpack_from("<HIIIH", cell, 2)
        name = cell[20 : 20 + length].decode("cp1252" if flags & 1 else "utf-16-le", "replace")
        if size & 0x80000000:
            data = cell[8 : 8 + (size & 0x7FFFFFFF)]
        else:
            data = self.cell(at)
            if size > SEGMENT and data[:2] == b"db":
                n, listed = struct.unpack_from("<HI", data, 2)
                parts = struct.unpack_from(f"<{n}I", self.cell(listed))
                data = b"".join(self.cell(p)[:SEGMENT] for p in parts)
            data = data[:size]
        return name, VALUE_TYPES[kind] if kind < len(VALUE_TYPES) else f"REG_{kind}", data


def shown(kind: str, data: bytes) -> str:
    """A value's data as text: strings as they are, several joined with |, numbers in decimal, everything else in hex."""
    if kind in ("REG_SZ", "REG_EXPAND_SZ", "REG_LINK"):
        return data.decode("utf-16-le", "replace").split("\0")[0]
    if kind == "REG_MULTI_SZ":
        return "|".join(x for x in data.decode("utf-16-le", "replace").split("\0") if x)
    if kind in ("REG_DWORD", "REG_QWORD"):
        return str(int.from_bytes(data, "little"))
    return str(int.from_bytes(data, "big")) if kind == "REG_DWORD_BIG_ENDIAN" else data.hex()


def hive_values(content: bytes) -> list[tuple]:
    """(key, modified_us, name, type, value) of every value of a hive; a key without values is one row with nulls. Keys are paths below the root."""
    hive, out = Hive(content), []
    waiting, seen = [(hive.root, "")], set()
    while waiting:
        offset, path = waiting.pop()
        if offset in seen:
            continue
        seen.add(offset)
        cell = hive.cell(offset)
        if cell[:2] != b"nk":
            raise ValueError(f"no key at {offset}")
        flags, written = struct.unpack_from("<Hq", cell, 2)
        keys, listed = struct.unpack_from("<I4xI", cell, 20)
        count, values = struct.unpack_from("<II", cell, 36)
        length = struct.unpack_from("<H", cell, 72)[0]
        name = cell[76 : 76 + length].decode("cp1252" if flags & 0x20 else "utf-16-le", "replace")
        here = "" if offset == hive.root else f"{path}/{name}" if path else name
        modified = (written - _EPOCH) // 10
        found = [hive.value(v) for v in struct.unpack_from(f"<{count}I", hive.cell(values))] if count else []
        out += [(here, modified, n, kind, shown(kind, data)) for n, kind, data in found] or [(here, modified, None, None, None)]
        if keys:
            waiting += [(k, here) for k in reversed(hive.below(listed))]
    return out


def registry_values(frame: DataFrame, errors: bool = False) -> DataFrame:
    """The values of each hive in ``frame`` (path, content)."""
    return decoded(frame, lambda _, c: hive_values(c), "key string, modified_us bigint, name string, type string, value string", errors)


# Where a system keeps its facts; a key matches with these last parts, whatever control set it is in.
FACTS = {
    "hostname": ("Control/ComputerName/ComputerName", "ComputerName"), "time_zone": ("Control/TimeZoneInformation", "TimeZoneKeyName"), "code_page": ("Control/Nls/CodePage", "ACP"),
    "product": ("Microsoft/Windows NT/CurrentVersion", "ProductName"), "system_root": ("Microsoft/Windows NT/CurrentVersion", "SystemRoot"),
}
#: Facts are collected in this order: what file systems tell, what hives tell, and what follows from both.
ORDER = ("file_system", "registry", "knowledge_base")


def _under(key: Column, tail: str) -> Column:
    return F.lower(key).endswith(tail.lower())


def system_facts(values: DataFrame, by: str = "path") -> DataFrame:
    """(by, fact, value) of each hive or system; of several control sets the first in the order of their names counts. What is missing has no row."""
    kinds = F.array(*(F.when(_under(F.col("key"), tail) & (F.lower("name") == name.lower()), F.lit(fact)) for fact, (tail, name) in FACTS.items()))
    hits = values.select(by, "key", "value", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("fact"))
    return hits.groupBy(by, "fact").agg(F.min_by("value", "key").alias("value"))


def user_accounts(values: DataFrame, by: str = "path") -> DataFrame:
    """(by, sid, folder, user) of the profiles that a system lists; the user's name is that of the folder."""
    listed = values.filter(F.lower("key").contains("/profilelist/s-1-") & (F.lower("name") == "profileimagepath"))
    return listed.select(by, F.substring_index("key", "/", -1).alias("sid"), F.col("value").alias("folder"), F.regexp_extract("value", r"([^\\/]*)$", 1).alias("user"))
