"""Verification queries over the source tables, one per operator, with oracle SQL."""
from __future__ import annotations

import importlib
import pkgutil

from panelspark.catalog.base import REGISTRY, oracle, spark_query

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"{__name__}.{_m}")


def queries():
    return {name: spark_query(name) for name in sorted(REGISTRY)}


def oracle_sql():
    return {name: sql for name in sorted(REGISTRY) if (sql := oracle(name)) is not None}
