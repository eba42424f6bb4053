"""Binary records of file systems: master file table, change journal and shell links. Each decoder takes bytes and gives rows."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from tracewright.sources.files import decoded

# Bits of a change's reason, in the order in which they are written.
REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION",
    0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE",
    0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE",
    0x200000: "STREAM_CHANGE", 0x80000000: "CLOSE",
}
_EPOCH = 116_444_736_000_000_000


def journal_records(content: bytes) -> list[tuple]:
    """(offset, reference, parent, usn, time_us, reason, name) of version 2 records; zeros between records are skipped."""
    out, at, n = [], 0, len(content)
    while at + 60 <= n:
        size, major = struct.unpack_from("<IH", content, at)
        if size < 60 or at + size > n or major != 2:
            at += 8
            continue
        ref, parent, usn, time, reason, _, _, _, length, start = struct.unpack_from("<QQqqIIIIHH", content, at + 8)
        name = content[at + start : at + start + length].decode("utf-16-le", "replace")
        words = " ".join(w for bit, w in REASONS.items() if reason & bit)
        out.append((at, _signed(ref), _signed(parent), usn, (time - _EPOCH) // 10, words, name))
        at += (size + 7) & ~7
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_records(content: bytes, size: int = 1024) -> list[tuple]:
    """(entry, sequence, in_use, is_directory, name, parent, created_us, modified_us) of file records with a name attribute."""
    out = []
    for at in range(0, len(content) - size + 1, size):
        record = bytearray(content[at : at + size])
        if record[:4] != b"FILE":
            continue
        fix, count, sequence, first, flags = struct.unpack_from("<HH", record, 4) + struct.unpack_from("<H", record, 16) + struct.unpack_from("<HH", record, 20)
        for k in range(1, count):  # the last two bytes of each sector are kept in the fix-up list
            if 512 * k <= size:
                record[512 * k - 2 : 512 * k] = record[fix + 2 * k : fix + 2 * k + 2]
        entry = struct.unpack_from("<I", record, 44)[0] if fix >= 48 else at // size
        best, p = None, first
        while p + 24 <= size:
            kind, length = struct.unpack_from("<II", record, p)
            if kind == 0xFFFFFFFF or length < 24 or p + length > size:
                break
            if kind == 0x30 and not record[p + 8]:
                body = p + struct.unpack_from("<H", record, p + 20)[0]
                parent, created, modified = struct.unpack_from("<Qqq", record, body)
                chars, space = record[body + 64], record[body + 65]
                name = bytes(record[body + 66 : body + 66 + 2 * chars]).decode("utf-16-le", "replace")
                if best is None or space != 2:  # a long name goes before a short one
                    best = (name, _signed(parent), (created - _EPOCH) // 10, (modified - _EPOCH) // 10)
            p += length
        if best:
            out.append((entry, sequence, bool(flags & 1), bool(flags & 2), *best))
    return out


def link_target(content: bytes) -> list[tuple]:
    """(created_us, accessed_us, written_us, size, local_path) of a shell link."""
    if content[:4] != b"\x4c\0\0\0":
        return []
    flags = struct.unpack_from("<I", content, 20)[0]
    created, accessed, written, size = struct.unpack_from("<qqqI", content, 28)
    at, path = 76, None
    if flags & 1:
        at += 2 + struct.unpack_from("<H", content, at)[0]
    if flags & 2:
        base = struct.unpack_from("<I", content, at + 16)[0]
        if base:
            path = content[at + base :].split(b"\0", 1)[0].decode("cp1252", "replace")
    return [((created - _EPOCH) // 10, (accessed - _EPOCH) // 10, (written - _EPOCH) // 10, size, path)]


def journal(frame: DataFrame) -> DataFrame:
    return decoded(frame, lambda _, c: journal_records(c), "offset bigint, reference bigint, parent bigint, usn bigint, time_us bigint, reason string, name string")


def file_table(frame: DataFrame) -> DataFrame:
    return decoded(frame, lambda _, c: table_records(c), "entry bigint, sequence int, in_use boolean, is_directory boolean, name string, parent bigint, created_us bigint, modified_us bigint")


def links(frame: DataFrame) -> DataFrame:
    return decoded(frame, lambda _, c: link_target(c), "created_us bigint, accessed_us bigint, written_us bigint, size bigint, local_path string")


# Kinds of partitions by their code in a master boot record.
PARTITION_KINDS = {0x01: "FAT12", 0x04: "FAT16", 0x05: "Extended", 0x06: "FAT16", 0x07: "NTFS/exFAT", 0x0B: "FAT32", 0x0C: "FAT32", 0x0E: "FAT16", 0x0F: "Extended", 0x82: "Linux swap", 0x83: "Linux", 0xAF: "HFS", 0xEE: "GPT", 0xEF: "EFI"}


def partition_entries(content: bytes, sector: int = 512) -> list[tuple]:
    """(number, start_sector, sectors, kind, label) of a disk's partition table: those of a GUID table if there is one, else the four of the boot record.

    ``content`` holds at least the table's sectors. Empty entries are skipped but counted; a disk without a table has none.
    """
    if content[510:512] != b"\x55\xaa":
        return []
    if content[sector : sector + 8] == b"EFI PART":
        first, count, size = struct.unpack_from("<QII", content, sector + 72)
        out = []
        for k in range(count):
            at = first * sector + k * size
            entry = content[at : at + size]
            if len(entry) < 128 or not any(entry[:16]):
                continue
            kind = entry[:16]
            guid = f"{kind[3::-1].hex()}-{kind[5:3:-1].hex()}-{kind[7:5:-1].hex()}-{kind[8:10].hex()}-{kind[10:].hex()}"
            start, end = struct.unpack_from("<QQ", entry, 32)
            out.append((k, start, end - start + 1, guid, entry[56:128].decode("utf-16-le", "replace").split("\0")[0]))
        return out
    out = []
    for k in range(4):
        kind, start, sectors = struct.unpack_from("<B3xII", content, 446 + 16 * k + 4)
        if kind and sectors:
            out.append((k, start, sectors, PARTITION_KINDS.get(kind, f"0x{kind:02X}"), None))
    return out


def recycled_entry(content: bytes) -> list[tuple]:
    """(size, deleted_us, original_path) of a recycle bin's index file: the older version has a path of fixed length, the newer one its length."""
    version, size, deleted = struct.unpack_from("<QQq", content)
    if version == 1:
        name = content[24 : 24 + 520]
    elif version == 2:
        name = content[28 : 28 + 2 * struct.unpack_from("<I", content, 24)[0]]
    else:
        raise ValueError(f"version {version}")
    return [(size, (deleted - _EPOCH) // 10, name.decode("utf-16-le", "replace").split("\0")[0])]


def prefetch_entry(content: bytes) -> list[tuple]:
    """(name, version, run_count, run_us) of an uncompressed prefetch file; the versions keep one or up to eight times of runs."""
    version, mark = struct.unpack_from("<I4s", content)
    if mark != b"SCCA" or version not in (17, 23, 26, 30):
        raise ValueError("no prefetch file")
    name = content[16:76].decode("utf-16-le", "replace").split("\0")[0]
    at, runs, count_at = {17: (120, 1, 144), 23: (128, 1, 152), 26: (128, 8, 208), 30: (128, 8, 208)}[version]
    if version == 30 and struct.unpack_from("<I", content, 84)[0] < 304:  # the shorter of two layouts
        count_at = 200
    times = [t for t in struct.unpack_from(f"<{runs}q", content, at) if t]
    return [(name, version, struct.unpack_from("<I", content, count_at)[0], [(t - _EPOCH) // 10 for t in times])]


def partitions(frame: DataFrame, errors: bool = False) -> DataFrame:
    return decoded(frame, lambda _, c: partition_entries(c), "number int, start_sector bigint, sectors bigint, kind string, label string", errors)


def recycled(frame: DataFrame, errors: bool = False) -> DataFrame:
    return decoded(frame, lambda _, c: recycled_entry(c), "size bigint, deleted_us bigint, original_path string", errors)


def prefetched(frame: DataFrame, errors: bool = False) -> DataFrame:
    return decoded(frame, lambda _, c: prefetch_entry(c), "name string, version int, run_count int, run_us array<bigint>", errors)
