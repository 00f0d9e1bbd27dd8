"""Queries over the driver's tables, one per operator, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("columns", "extracts", "staging", "provisioning", "stored")


def load():
    """(queries, sql) of all modules."""
    for module in MODULES:
        importlib.import_module(f"codexferry.bindings.{module}")
    from codexferry.bindings.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
