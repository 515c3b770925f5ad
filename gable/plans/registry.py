"""Registering a query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable


def registrar(to: dict) -> Callable:
    def query(sql: str | None = None) -> Callable:
        def add(build: Callable) -> Callable:
            to[build.__name__] = (build, sql)
            return build

        return add

    return query
