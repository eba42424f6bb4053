"""Deeply nested records to related flat tables.

A bottom-up tree automaton reads each JSON tree: an object's state is found from the field that holds it, its set of fields and the
states below. Final states are variants; a variant belongs to a subtype (a typed table), and what no rule knows goes to the
subtype ``other`` with its own signature, so nothing is lost. Every node keeps the common supertype columns: record, node path, parent
path, subtype, variant, depth and position. Parsing is one Arrow pass without a shuffle; records are independent of each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import spread

NODE_SCHEMA = "node string, parent_node string, subtype string, variant string, depth int, position int, fields string"


@dataclass(frozen=True)
class Rule:
    """A transition: an object under one of ``labels`` that has all of ``needs`` goes to the state ``subtype``."""

    subtype: str
    labels: frozenset[str]
    needs: frozenset[str]
    columns: dict[str, str] = field(hash=False)


def rule(subtype: str, labels: str, needs: str, **columns: str) -> Rule:
    return Rule(subtype, frozenset(labels.split()), frozenset(needs.split()), columns)


#: The rules for records of a file-system journal, tried in order. Values that don't fit their column's type come out as null there.
JOURNAL_RULES = (
    rule("standard_information", "std_info", "attr_val", attr_val="string", m_time="string", a_time="string", c_time="string", e_time="string", file_attributes="string"),
    rule("file_name", "file_name second_file_name", "attr_val", attr_val="string", m_time="string", a_time="string", c_time="string", e_time="string", file_name="string", parent_reference="bigint", parent_file_path="string"),
    rule("stream", "streams", "name", name="string", size="bigint"),
    rule("run", "runs", "lcn length", lcn="bigint", length="bigint"),
    rule("hash", "hash", "kind value", kind="string", value="string"),
    rule("time", "times", "kind value", kind="string", value="string"),
    rule("parent", "parent", "reference", reference="bigint"),
    rule("ancestor", "ancestors", "name sequence", name="string", sequence="bigint"),
    rule("owner", "owner", "sid", sid="string"),
    rule("quota", "quota", "charged", charged="bigint"),
    rule("flag", "file_attributes", "flag", flag="string", set="boolean"),
)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_LITERALS = {"true": True, "false": False, "null": None}


def _scalar(text: str, at: int):
    """(value, end) of the string, number or literal at ``at``."""
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    for word, value in _LITERALS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(f"no value at {at}")
    return (int(m.group()) if m.group().lstrip("-").isdigit() else float(m.group())), m.end()


def read_deep(text: str):
    """What the standard reader gives, for nesting of any depth: open objects and arrays wait on a stack of its own."""
    skip = lambda i: _SPACE.match(text, i).end()
    top: list = []
    open_: list = [top]
    keys: list[str] = []
    at = skip(0)
    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            inner: dict | list = {} if mark == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if mark == "{" else "]"):
                value, at = inner, skip(at + 1)
            else:
                open_.append(inner)
                if mark == "{":
                    at = _key(text, at, keys, skip)
                continue
        else:
            value, at = _scalar(text, at)
            at = skip(at)
        while True:  # put the value where it belongs; a closed container is the next value
            above = open_[-1]
            if isinstance(above, dict):
                above[keys.pop()] = value
            else:
                above.append(value)
            if above is top:
                if at != len(text):
                    raise ValueError(f"extra data at {at}")
                return top[0]
            mark = text[at : at + 1]
            if mark == ",":
                at = skip(at + 1)
                if isinstance(above, dict):
                    at = _key(text, at, keys, skip)
                break
            if mark != ("}" if isinstance(above, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value, at = open_.pop(), skip(at + 1)


def _key(text: str, at: int, keys: list[str], skip) -> int:
    """Read a field's name and the colon behind it; the place of its value."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    keys.append(key)
    return skip(at + 1)


def read_json(text: str):
    """Strict JSON of any depth; raises ValueError otherwise (also for NaN)."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return read_deep(text)


_JSON_TEXT = re.compile(r"\s*[\[{\"]")


def unquote(value):
    """An object or array stored as JSON text inside a string, as if it stood there unquoted; also if quoted several times."""
    while isinstance(value, str) and _JSON_TEXT.match(value):
        try:
            inner = read_json(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str) and not _JSON_TEXT.match(inner):
            return value
        value = inner
    return value


def nodes_of(text: str | None, roots: tuple[str, ...], rules: tuple[Rule, ...] = JOURNAL_RULES) -> list[tuple]:
    """The nodes of one record in the order of NODE_SCHEMA. Null, blank, broken and non-object texts have none."""
    if not text:
        return []
    try:
        top = unquote(read_json(text))
    except ValueError:
        return []
    out: list[tuple] = []
    if isinstance(top, dict):
        for name in roots:
            if name in top:
                value = unquote(top[name])
                if isinstance(value, (dict, list)):
                    _visit(value, name, rules, out)
    return out


def _visit(value, label: str, rules, out: list[tuple]) -> None:
    """Add the nodes at and below ``value``, each before those below it. The stack is explicit and paths are put together for objects only, so any
    depth can be walked."""
    stack = [_Frame(value, label, "", "", 0, 0, out)]
    while stack:
        frame = stack[-1]
        child = next(frame.children, None)
        if child is not None:
            key, v, index = child
            if isinstance(v, (dict, list)):
                frame.pending = key
                if frame.is_list:
                    stack.append(_Frame(v, label if key is None else key, frame.node, frame.parent, frame.depth, index, out, (frame.steps, index)))
                else:
                    stack.append(_Frame(v, key, f"{frame.node}.{key}", frame.node, frame.depth + 1, 0, out))
            elif frame.is_list:
                frame.states.add("scalar")
            continue
        state = frame.close(rules, out)
        stack.pop()
        if stack:
            above = stack[-1]
            if not above.is_list:
                above.states.add(f"{above.pending}:{state}")
            elif frame.is_list:  # arrays in arrays have the states of their elements
                above.states |= frame.states
            else:
                above.states.add(state)


class _Frame:
    """An object or array that is being visited. ``steps`` are the positions in the arrays around it, innermost first, as linked pairs."""

    __slots__ = ("at", "children", "depth", "is_list", "keys", "label", "node", "parent", "pending", "plain", "position", "states", "steps")

    def __init__(self, value, label: str, path: str, parent: str, depth: int, position: int, out: list[tuple], steps=None) -> None:
        self.is_list, self.states, self.label, self.parent, self.depth, self.position, self.steps = isinstance(value, list), set(), label, parent, depth, position, steps
        self.node = path or label
        if self.is_list:
            self.children = ((label, unquote(v), i) for i, v in enumerate(value))
            return
        self.keys, self.plain, self.at = value.keys(), {}, len(out)
        if value:
            out.append(())
        places = []
        while steps is not None:
            steps, index = steps
            places.append(f"[{index}]")
        self.node += "".join(reversed(places)) or "[0]"
        below = []
        for k, v in value.items():
            v = unquote(v)
            if isinstance(v, (dict, list)):
                below.append((k, v, 0))
            if not isinstance(v, dict) and not (isinstance(v, list) and (not v or any(isinstance(x, (dict, list)) for x in v))):
                self.plain[k] = v
        self.children = iter(below)

    def close(self, rules, out: list[tuple]) -> str:
        """The state, once all below is known; an object's node is written."""
        if self.is_list:
            return "[" + ",".join(sorted(self.states)) + "]"
        if not self.keys:
            return "empty"
        state = next((r.subtype for r in rules if self.label in r.labels and r.needs <= self.keys), "other")
        variant = f"{state}({','.join(sorted(self.keys))})" + ("{" + ",".join(sorted(self.states)) + "}" if self.states else "")
        out[self.at] = (self.node, self.parent, state, variant, self.depth, self.position, json.dumps(self.plain, ensure_ascii=False))
        return state


def explode_nested(frame: DataFrame, column: str, roots: tuple[str, ...], row: str = "row_id", rules: tuple[Rule, ...] = JOURNAL_RULES) -> DataFrame:
    """(row, NODE_SCHEMA): each object with at least one field under ``roots``, at any depth, of each record of ``frame``.

    node is the path with a position at every step, parent_node the path of the object that holds it or the empty string. Null, blank,
    broken and non-object records have no node; repeated records have their own each. Only two columns are read, so others may be
    called as they like. Of a field that an object has twice, the last holds. fields has the scalar fields as JSON.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch["r"], batch["t"], strict=True):
                found = nodes_of(text, roots, rules)
                rows += found
                ids += [i] * len(found)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "r", ids)
            yield out

    kind = frame.schema[row].dataType.simpleString()
    read = spread(frame.select(F.col(row).alias("r"), F.col(column).cast("string").alias("t")).filter(F.col("t").isNotNull()))
    return read.mapInPandas(run, f"r {kind}, {NODE_SCHEMA}").withColumnRenamed("r", row)


def node_links(frame: DataFrame, column: str, roots: tuple[str, ...], row: str = "row_id", rules: tuple[Rule, ...] = JOURNAL_RULES) -> DataFrame:
    """(row, node, parent_node) alone."""
    return explode_nested(frame, column, roots, row, rules).select(row, "node", "parent_node")


def subtype_table(nodes: DataFrame, subtype: str, rules: tuple[Rule, ...] = JOURNAL_RULES, row: str = "row_id") -> DataFrame:
    """The typed table of a subtype: supertype columns and the rule's columns, which are prefixed with ``f_`` so that none clashes."""
    columns = next(r.columns for r in rules if r.subtype == subtype)
    typed = [F.get_json_object("fields", f"$.{c}").try_cast(kind).alias(f"f_{c}") for c, kind in columns.items()]
    return nodes.filter(F.col("subtype") == subtype).select(row, "node", "parent_node", "variant", "depth", "position", *typed)


def variant_counts(nodes: DataFrame) -> DataFrame:
    """How often each variant occurs."""
    return nodes.groupBy("subtype", "variant", "depth").agg(F.count(F.lit(1)).alias("objects"))
