"""Registration of queries next to the SQL that gives the same result."""

from __future__ import annotations


def registry():
    """Empty query and SQL tables, and the decorator that fills them."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn

        return add

    return queries, oracle, query
