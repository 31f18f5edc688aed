"""A place where query modules put their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def keep(function: Callable) -> Callable:
            if name in self.found:
                raise ValueError(f"two queries are named {name}")
            self.found[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return keep
