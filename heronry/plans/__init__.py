"""Registry of the core's named queries and of the SQL each is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules with QUERIES (name -> f(spark, sf_dir)) and SQL (name -> DuckDB text).
MODULES: tuple[str, ...] = ("heronry.plans.relational", "heronry.plans.scalars", "heronry.plans.domain", "heronry.plans.live", "heronry.plans.extras", "heronry.operators.units")


def _parts():
    for name in MODULES:
        yield importlib.import_module(name)


def queries() -> dict[str, Callable]:
    return {k: f for m in _parts() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _parts() for k, s in m.SQL.items()}
