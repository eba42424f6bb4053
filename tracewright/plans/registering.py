"""Queries under their names, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function as a query under its name."""

        def keep(f: Callable) -> Callable:
            if f.__name__ in self.functions:
                raise KeyError(f"{f.__name__} is registered already")
            self.functions[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
