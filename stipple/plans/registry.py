"""All named queries of the core, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from stipple.plans import core_problems, core_queries, io_queries, more_queries

_MODULES = (core_problems, core_queries, io_queries, more_queries)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
