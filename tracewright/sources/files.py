"""Files as tables: catalogues, archives, mails, logs, pages and carved blocks.

Everything starts from Spark's ``binaryFile`` reader, which prunes the content if only metadata is asked for; decoders run file by file in
Arrow batches. A file that can't be decoded gives one row with the kind of error and nulls beside it, so that no damage goes unseen.
"""

from __future__ import annotations

import contextlib
import email
import email.policy
import io
import json
import plistlib
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import texts


def file_scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, parent_path, extension, size, mtime) of every file below ``folder``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(path.alias("path"), texts.base_name(path).alias("name"), texts.folder(path).alias("parent_path"), texts.extension(texts.base_name(path)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")


#: ``**`` in a search path goes at most so deep.
DEEPEST = 10


def found_by(files: DataFrame, segments: list[str], variables: dict[str, list[str]] | None = None, path: str = "path") -> DataFrame:
    """The files whose last segments match regular expressions regardless of case; ``%name%`` in a segment stands for any of its values, and the
    segment ``**`` for up to ``DEEPEST`` folders."""

    def filled(s: str) -> str:
        for k, values in (variables or {}).items():
            s = re.sub(re.escape(f"%{k}%"), lambda _, v=values: "(?:" + "|".join(re.escape(x) for x in v) + ")", s, flags=re.I)
        return s

    pattern = "".join(rf"(?:[^/]+/){{0,{DEEPEST}}}" if s == "**" else filled(s) + "/" for s in segments).removesuffix("/")
    return files.filter(F.col(path).rlike(f"(?i)/{pattern}$"))


def unique_versions(files: DataFrame, inode: str, times: list[str]) -> DataFrame:
    """One row for each file and state of its times: a file that several snapshots hold unchanged comes out once. Null times are times like others."""
    state = F.xxhash64(*(F.coalesce(F.col(t).cast("string"), F.lit("")) for t in times))
    return files.withColumn("time_hash", state).dropDuplicates([inode, "time_hash"])


def within_depth(files: DataFrame, depth: int, root: str, path: str = "path") -> DataFrame:
    """The files at most ``depth`` folders below ``root``."""
    below = F.substring(F.col(path), F.lit(len(root.rstrip("/")) + 2), F.length(path))
    return files.filter(F.col(path).startswith(root.rstrip("/") + "/") & (F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit(""))) <= depth))


def decoded(frame: DataFrame, decode: Callable[[str, bytes], list[tuple]], schema: str, errors: bool = False) -> DataFrame:
    """The rows that ``decode(path, content)`` gives for each file, with its path first.

    A damaged file doesn't end the job. With ``errors`` there is a last column ``error``: null, or the kind of error of a file that has no other row;
    without, the rows with an error are filtered out (for readers that only ask for what can be read).
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *r, None) for r in decode(path, bytes(content))] if content is not None else []
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file
                    kind = type(e)
                    rows.append((path, *[None] * len(names), f"{kind.__module__}.{kind.__qualname__}".removeprefix("builtins.")))
            yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    out = frame.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")
    return out if errors else out.filter("error is null").drop("error")


def damaged(frame: DataFrame, reader: Callable[..., DataFrame]) -> DataFrame:
    """(path, error) of the files that a reader of this module can't decode."""
    return reader(frame, errors=True).filter("error is not null").select("path", "error")


def zip_entries(frame: DataFrame, errors: bool = False) -> DataFrame:
    """(path, entry, size) of each member of each archive."""

    def decode(path: str, content: bytes) -> list[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(i.filename, i.file_size) for i in z.infolist()]

    return decoded(frame, decode, "entry string, size bigint", errors)


_MAIL = "sender string, receivers string, cc string, bcc string, subject string, sent string, body string"


def _mail(content: bytes) -> tuple:
    m = email.message_from_bytes(content, policy=email.policy.default)
    every = lambda k: ",".join(a.strip() for v in m.get_all(k, []) for a in str(v).split(",") if a.strip())
    body = m.get_body(("plain", "html"))
    return str(m.get("From", "")), every("To"), every("Cc"), every("Bcc"), str(m.get("Subject", "")), str(m.get("Date", "")), body.get_content() if body else ""


def mails(frame: DataFrame, errors: bool = False) -> DataFrame:
    """(path, sender, receivers, cc, bcc, subject, sent, body) of RFC 822 files; mails without a receiver are dropped, lists are joined with commas."""
    return decoded(frame, lambda _, content: [row] if (row := _mail(content))[1] else [], _MAIL, errors)


def mail_boxes(frame: DataFrame, errors: bool = False) -> DataFrame:
    """The same of files that hold many mails one behind the other (mbox), with the ``number`` of the mail in its file.

    A mail begins at a line that starts with ``From `` behind a blank line or at the start; lines that were quoted for that lose their mark.
    """

    def decode(_: str, content: bytes) -> list[tuple]:
        starts = [m.start(1) for m in re.finditer(rb"(?:\A|\r?\n\r?\n)(From [^\n]*\n)", content)]
        out = []
        for i, (at, end) in enumerate(zip(starts, [*starts[1:], len(content)], strict=True)):
            row = _mail(re.sub(rb"(?m)^>(>*From )", rb"\1", content[content.index(b"\n", at) + 1 : end]))
            if row[1]:
                out.append((i, *row))
        return out

    return decoded(frame, decode, f"number bigint, {_MAIL}", errors)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.links, self.parts, self._in = "", [], [], []

    def handle_starttag(self, tag, attrs):
        self._in.append(tag)
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag):
        if tag in self._in:
            while self._in.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self._in:
            self.title += data
        elif not {"script", "style"} & set(self._in) and data.strip():
            self.parts.append(data.strip())


def pages(frame: DataFrame) -> DataFrame:
    """(path, title, links, text) of HTML files."""

    def decode(path: str, content: bytes) -> list[tuple]:
        p = _Text()
        p.feed(content.decode("utf-8", "replace"))
        return [(p.title.strip(), p.links, " ".join(p.parts))]

    return decoded(frame, decode, "title string, links array<string>, text string")


class _Activities(HTMLParser):
    """The cells of an activity page: action, link and what stands in the lines."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self._cell: dict | None = None
        self._depth, self._link = 0, False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "div":
            if self._cell is None and "content-cell" in (named.get("class") or ""):
                self._cell, self._depth = {"lines": [""], "title": "", "url": None}, 0
            self._depth += 1
        elif self._cell is not None and tag == "a" and self._cell["url"] is None:
            self._cell["url"], self._link = named.get("href"), True
        elif self._cell is not None and tag == "br":
            self._cell["lines"].append("")

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = False
        if tag == "div" and self._cell is not None:
            self._depth -= 1
            if not self._depth:
                lines = [x.replace("\xa0", " ").strip() for x in self._cell["lines"]]
                self.rows.append((lines[0], self._cell["title"].strip(), self._cell["url"], lines[-1] if len(lines) > 1 else None))
                self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            if self._link:
                self._cell["title"] += data
            else:
                self._cell["lines"][-1] += data


def activities(frame: DataFrame, errors: bool = False) -> DataFrame:
    """(path, action, title, url, at) of the entries of activity pages: what was done, to what, and the last line, which is the time as written."""

    def decode(_: str, content: bytes) -> list[tuple]:
        p = _Activities()
        p.feed(content.decode("utf-8", "replace"))
        return p.rows

    return decoded(frame, decode, "action string, title string, url string, at string", errors)


def property_lists(frame: DataFrame) -> DataFrame:
    """(path, key, value) of the top-level entries of property lists; nested values as JSON."""

    def decode(path: str, content: bytes) -> list[tuple]:
        top = plistlib.loads(content)
        entries = top.items() if isinstance(top, dict) else enumerate(top)
        return [(str(k), v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False)) for k, v in entries]

    return decoded(frame, decode, "key string, value string")


def usage_statistics(spark: SparkSession, folder: str, base: Column | None = None) -> DataFrame:
    """(path, span, package, last_active, time_active) of XML usage files: a negative last time is absolute, else it counts from the file's own time, which is its name."""
    rows = spark.read.format("xml").option("rowTag", "package").load(folder).select("*", F.input_file_name().alias("path"))
    last = F.col("_lastTimeActive").cast("bigint")
    own = F.regexp_extract("path", r"/(\d+)(?:\.xml)?$", 1).try_cast("bigint") if base is None else base
    return rows.select("path", F.regexp_extract("path", r"/(daily|weekly|monthly|yearly)/", 1).alias("span"), F.col("_package").alias("package"), F.when(last < 0, F.abs(last)).otherwise(own + last).alias("last_active"), F.col("_timeActive").cast("bigint").alias("time_active"))


def log_entries(spark: SparkSession, folder: str, starts: str) -> DataFrame:
    """(path, line, text) of text logs, where lines that don't match ``starts`` continue the entry before. A file is one ordered unit."""
    from tracewright.operators.windows import merged_lines

    lines = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return merged_lines(lines.filter("text <> ''"), ["path"], "line", "text", F.col("text").rlike(starts))


def hash_set(spark: SparkSession, path: str) -> DataFrame:
    """(digest): the first column of a CSV of hashes, upper case, distinct."""
    first = spark.read.option("header", False).csv(path)
    return first.select(F.upper(F.trim(first.columns[0])).alias("digest")).filter("digest <> ''").distinct()


# Leading bytes of file types (hex), and the type that an extension promises.
SIGNATURES = (("ffd8ff", 0, "jpeg"), ("89504e470d0a1a0a", 0, "png"), ("474946383961", 0, "gif"), ("25504446", 0, "pdf"), ("504b0304", 0, "zip"), ("d0cf11e0a1b11ae1", 0, "olecf"), ("53514c69746520666f726d6174203300", 0, "sqlite"), ("4d5a", 0, "exe"), ("456c6646696c6500", 0, "evtx"), ("72656766", 0, "registry"), ("4d414d04", 0, "prefetch"), ("46494c4530", 0, "mft"), ("1f8b08", 0, "gzip"))
PROMISED = {"hwp": "olecf", "doc": "olecf", "xls": "olecf", "ppt": "olecf", "docx": "zip", "xlsx": "zip", "pptx": "zip", "pdf": "pdf"}


def signature(content: Column, table: tuple = SIGNATURES) -> Column:
    """The type by bytes at an offset, which counts from the end if it is negative; the longest signature counts, null without any."""
    out = F.lit(None).cast("string")
    for hexed, offset, name in sorted(table, key=lambda t: len(t[0])):
        out = F.when(F.substring(content, offset + 1 if offset >= 0 else offset, len(hexed) // 2) == F.unhex(F.lit(hexed)), name).otherwise(out)
    return out


def mismatched(ext: Column, kind: Column) -> Column:
    """Whether a file isn't what its extension promises; null for extensions that promise nothing."""
    promised = F.create_map(*(F.lit(x) for kv in PROMISED.items() for x in kv))[F.lower(ext)]
    return F.when(promised.isNotNull(), F.coalesce(promised != kind, F.lit(True)))


def carved(frame: DataFrame, block: int = 4096) -> DataFrame:
    """(path, offset, kind): every block that begins with a signature. Blocks are cut out in the JVM, none is held in Python."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("content") - 1) / block), F.lit(0)))
    blocks = frame.filter(F.length("content") > 0).select("path", "content", F.explode(starts).alias("b"))
    hit = blocks.select("path", (F.col("b") * block).alias("offset"), signature(F.substring(F.col("content"), F.col("b").cast("int") * block + 1, F.lit(16))).alias("kind"))
    return hit.filter("kind is not null")


def merged_blocks(hits: DataFrame, block: int = 4096) -> DataFrame:
    """(path, kind, offset, blocks): neighbouring blocks of a kind as one run."""
    from pyspark.sql import Window

    run = F.col("offset") - F.row_number().over(Window.partitionBy("path", "kind").orderBy("offset")) * block
    return hits.withColumn("_r", run).groupBy("path", "kind", "_r").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("blocks")).drop("_r")


def event_texts(frame: DataFrame, xml: str) -> DataFrame:
    """``frame`` with event_id, channel, time_created and user_sid read from an event's XML; null where there is none."""
    get = lambda p: F.nullif(F.xpath_string(F.col(xml), F.lit(p)), F.lit(""))
    name = lambda n: f"//*[local-name()='{n}']"
    return frame.select("*", get(name("EventID")).alias("event_id"), get(name("Channel")).alias("channel"), get(name("TimeCreated") + "/@SystemTime").alias("time_created"), get(name("Security") + "/@UserID").alias("user_sid"))


def document_texts(frame: DataFrame, plugins: dict[str, Callable[[bytes], tuple[str, str]]] | None = None, errors: bool = False) -> DataFrame:
    """(path, kind, text, revisions) of office documents and plain texts: the words of their XML, and the revision ids of text documents.

    ``plugins`` gives readers for other extensions, or other readers for these: content -> (text, revisions).
    """
    import xml.etree.ElementTree as tree

    bodies = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/sharedStrings\.xml"}

    def decode(path: str, content: bytes) -> list[tuple]:
        kind = path.rpartition(".")[2].lower()
        if plugins and kind in plugins:
            return [(kind, *plugins[kind](content))]
        if kind == "txt":
            return [(kind, content.decode("utf-8", "replace"), "")]
        if kind not in bodies:
            return []
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(bodies[kind], n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
            words = [e.text for n in names for e in tree.fromstring(z.read(n)).iter() if e.tag.rpartition("}")[2] == "t" and e.text]
            settings = tree.fromstring(z.read("word/settings.xml")).iter() if "word/settings.xml" in z.namelist() else []
            ids = [v for e in settings if e.tag.rpartition("}")[2].startswith("rsid") for v in e.attrib.values()]
        return [(kind, " ".join(words), "".join(ids))]

    return decoded(frame, decode, "kind string, text string, revisions string", errors)


def sqlite_rows(frame: DataFrame, query: str, schema: str, errors: bool = False) -> DataFrame:
    """The rows that ``query`` gives in each SQLite file of ``frame`` (path, content), wherever the files lie; nothing is copied to a disk.

    What a log beside the file holds isn't seen; for that, ``sources.sqlite`` opens local files.
    """

    def decode(_: str, content: bytes) -> list[tuple]:
        with contextlib.closing(sqlite3.connect(":memory:")) as db:
            db.deserialize(content)
            return db.execute(query).fetchall()

    return decoded(frame, decode, schema, errors)
