"""Every registered query of the listing engine: a DataFrame builder and, where SQL can express it, its check."""

from __future__ import annotations

from . import details, expressions, geo, observatory, operations, scoring, sources, streams

MODULES = (expressions, observatory, scoring, geo, operations, sources, streams, details)


def queries() -> dict:
    return {name: build for m in MODULES for name, (build, _) in m.REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.REGISTER.items() if sql}
