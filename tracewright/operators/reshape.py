"""Rows to more rows, columns to rows, trees to paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut


def labelled_times(frame: DataFrame, keep: list[str], times: dict[str, Column], label: str = "event", time: str = "at") -> DataFrame:
    """One row for each time column that says something: null, blank and times at or before 1970-01-01 are left out."""
    events = F.array(*(F.struct(F.lit(n).alias("l"), c.cast("string").alias("t")) for n, c in times.items()))
    rows = frame.select(*keep, F.explode(events).alias("e")).select(*keep, F.col("e.l").alias(label), F.col("e.t").alias(time))
    return rows.filter((F.trim(time) != "") & (F.col(time) > "1970-01-01 00:00:00"))


def emitted(frame: DataFrame, keep: list[str], rows: dict[str, tuple[Column, Column]], label: str = "event", value: str = "at") -> DataFrame:
    """For each name in ``rows`` a row with its value where its condition holds."""
    parts = F.array(*(F.when(c, F.struct(F.lit(n).alias("l"), v.alias("v"))) for n, (c, v) in rows.items()))
    return frame.select(*keep, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("e")).select(*keep, F.col("e.l").alias(label), F.col("e.v").alias(value))


def list_columns(text: Column, mark: str, n: int, prefix: str) -> list[Column]:
    """The first ``n`` parts of a list as columns, '' where there are fewer."""
    parts = F.split(text, mark)
    return [F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(f"{prefix}{i + 1}") for i in range(n)]


def map_rows(frame: DataFrame, keep: list[str], json: str) -> DataFrame:
    """(keep, key, value): the entries of a JSON object; broken JSON and null give none."""
    entries = F.from_json(F.col(json), "map<string,string>")
    return frame.select(*keep, F.explode(entries).alias("key", "value"))


def with_slack(frame: DataFrame, keep: list[str], name: str, size: Column, block: Column) -> DataFrame:
    """Each file as ``file`` and, if its last block isn't full, also as ``slack`` of the unused bytes."""
    from tracewright.functions.bits import slack_bytes

    return emitted(frame, [*keep, name], {"file": (F.lit(True), size), "slack": (slack_bytes(size, block) > 0, slack_bytes(size, block))}, "kind", "bytes")


def paths(frame: DataFrame, key: str, parent: str, name: str, mark: str = "/") -> DataFrame:
    """(key, path) of each node by its parents' names.

    Doubling: every round replaces each node's unfinished ancestor by that ancestor's own, so depth d takes log2(d) joins. Nodes whose
    parent is null or unknown are roots. Nodes on a circle have no path and are left out.
    """
    known = frame.select(F.col(key).alias("_k"))
    up = frame.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(name).alias("path")).join(known, F.col("up") == F.col("_k"), "left")
    state = cut(up.select("id", F.col("_k").alias("up"), "path"))
    while True:
        left = state.filter("up is not null").count()
        if not left:
            break
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = state.join(above, F.col("up") == F.col("_id"), "left")
        after = cut(joined.select("id", F.when(F.col("_id").isNotNull(), F.col("_up")).alias("up"), F.when(F.col("_id").isNotNull(), F.concat("_path", F.lit(mark), "path")).otherwise(F.col("path")).alias("path")))
        if after.filter("up is not null").count() == left and after.filter("up = id").count() == left:
            state = after.filter("up is null")
            break
        state = after.filter("up is null or up <> id")
    return state.select(F.col("id").alias(key), "path")


def tree_rows(frame: DataFrame, keep: list[str], json: str, children: str, name: str, root: str) -> DataFrame:
    """(keep, path, name, depth) of each node of a tree in JSON: an object with ``name`` and a list ``children`` of the same kind below ``root``."""
    import json as reader
    from collections.abc import Iterator

    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                *kept, text = row
                try:
                    top = reader.loads(text) if isinstance(text, str) else None
                except ValueError:
                    top = None
                stack = [(top.get(root), "", 0)] if isinstance(top, dict) else []
                while stack:
                    node, path, depth = stack.pop()
                    if not isinstance(node, dict):
                        continue
                    here = f"{path}/{node.get(name) or ''}"
                    out.append((*kept, here, node.get(name), depth))
                    below = node.get(children)
                    stack += [(c, here, depth + 1) for c in reversed(below)] if isinstance(below, list) else []
            yield pd.DataFrame(out, columns=[*keep, "path", "name", "depth"])

    return frame.select(*keep, json).mapInPandas(run, f"{schema}, path string, name string, depth int")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_priority(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Of alternative row sets, for each group only the rows of the first part that has any."""
    ranked = union_of([p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    best = ranked.groupBy(*by).agg(F.min("_p").alias("_p"))
    return ranked.join(best, [*by, "_p"]).drop("_p")


def with_streams(frame: DataFrame, keep: list[str], size: Column, streams: str) -> DataFrame:
    """(keep, kind, stream, bytes): each file as ``file`` with its own size and once more for each of its named ``streams`` (an array of name and size).

    Files without streams (a null or empty array) are one row.
    """
    own = F.struct(F.lit("file").alias("kind"), F.lit("").alias("stream"), size.cast("bigint").alias("bytes"))
    named = F.transform(streams, lambda s: F.struct(F.lit("stream").alias("kind"), s["name"].alias("stream"), s["size"].cast("bigint").alias("bytes")))
    every = F.when(F.col(streams).isNull(), F.array(own)).otherwise(F.concat(F.array(own), named))
    return frame.select(*keep, F.inline(every))


def notes_and_media(notes: DataFrame, media: DataFrame, content: str = "content") -> DataFrame:
    """The rows of both by column name; white space is taken out of what media hold."""
    return notes.unionByName(media.withColumn(content, F.regexp_replace(content, r"(?U)\s", "")))
