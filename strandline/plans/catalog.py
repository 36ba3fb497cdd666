"""A small register: a query, by name, with the SQL that checks it."""

from __future__ import annotations


class Catalog:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers the function below under the name; ``sql`` is what gives the same rows."""

        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep
