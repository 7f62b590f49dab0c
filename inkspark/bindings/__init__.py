"""Bindings of the operators to the tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib
import pkgutil

from inkspark.plans.registry import QUERIES, SQL

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["QUERIES", "SQL"]
