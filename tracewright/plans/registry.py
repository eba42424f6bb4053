"""Registries of sources and analyses, and the expression that selects among them."""

from __future__ import annotations

from collections.abc import Callable

from tracewright.sources import eventlogs, files, hives, records


class Registry:
    """Named entries; a name may be taken once."""

    def __init__(self) -> None:
        self._entries: dict[str, Callable] = {}

    def add(self, name: str, entry: Callable) -> Callable:
        if name.lower() in self._entries:
            raise KeyError(f"{name} is registered already")
        self._entries[name.lower()] = entry
        return entry

    def get(self, name: str) -> Callable:
        return self._entries[name.lower()]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def selected(self, expression: str | None) -> list[str]:
        """Names by an expression like ``a,!b,c/part``: plain names come in (all, if there are none), names with ``!`` go out; a part after a
        slash selects a plugin and leaves its owner in."""
        wanted, unwanted = set(), set()
        for item in filter(None, (x.strip().lower() for x in (expression or "").split(","))):
            (unwanted if item[0] == "!" else wanted).add(item.lstrip("!").split("/")[0])
        return [n for n in self.names() if (not wanted or n in wanted) and n not in unwanted]

    @staticmethod
    def plugins(expression: str | None, name: str) -> list[str]:
        """The plugins of ``name`` that an expression asks for."""
        items = (x.strip().lower() for x in (expression or "").split(","))
        return sorted(x.split("/")[1] for x in items if x.split("/")[0] == name.lower() and "/" in x)


def fitting_plugins(required: dict[str, set[str]], tables: set[str]) -> list[str]:
    """The plugins all of whose required tables are there."""
    return sorted(n for n, r in required.items() if r <= tables)


SOURCES, ANALYSES = Registry(), Registry()

# What can be read, by name: decoders of (path, content).
for _module, _names in ((files, ("zip_entries", "mails", "mail_boxes", "pages", "activities", "property_lists", "document_texts")), (records, ("journal", "file_table", "links", "partitions", "recycled", "prefetched")), (hives, ("registry_values",)), (eventlogs, ("event_logs",))):
    for _name in _names:
        SOURCES.add(_name, getattr(_module, _name))
