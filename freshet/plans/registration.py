"""A decorator that registers a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep
