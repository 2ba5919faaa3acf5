"""Operators for training-data preparation. Nothing else in heronry imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: One module for each problem; every module has QUERIES and SQL.
MODULES = ("markup", "rankfuse", "mainbody", "topn", "canonical", "names", "tokens", "leakage", "reading")


def _parts():
    for name in MODULES:
        yield importlib.import_module(f"{__name__}.{name}")


def queries() -> dict[str, Callable]:
    return {k: f for m in _parts() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _parts() for k, s in m.SQL.items()}
