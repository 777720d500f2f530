"""How a module of queries registers them under their functions' names, with their SQL."""

from __future__ import annotations


def registry():
    """A module's queries, their SQL, and the decorator that fills both."""
    queries: dict = {}
    statements: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query
