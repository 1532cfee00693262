"""Registry of verification queries: a Spark plan, an output spec and oracle SQL.

The output spec is one word per column: ``name`` (text), ``name:d`` (date, written as
ISO text), ``name:i`` (64-bit), ``name:b`` (boolean), ``name:f`` (double, 6 decimals),
``name:N`` (double, N decimals).  The same spec closes both sides.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from panelspark.catalog.oracle_views import VIEWS
from panelspark.plans.views import Views

REGISTRY: dict[str, tuple[Callable, str, str | None]] = {}


def query(name: str, spec: str, sql: str | None = None):
    def register(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, spec, sql)
        return fn
    return register


def _parts(spec: str):
    for word in spec.split():
        name, _, kind = word.partition(":")
        yield name, kind


def finish(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _parts(spec):
        c = F.col(name)
        if kind == "" or kind == "d":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), 6 if kind == "f" else int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def closed_sql(sql: str, spec: str) -> str:
    """Prepend the canonical views the text uses and cast the output columns."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v])
                need.append(v)
    visit(sql)
    out = []
    for name, kind in _parts(spec):
        if kind == "" or kind == "d":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "b":
            out.append(f"CAST({name} AS BOOLEAN) AS {name}")
        else:
            out.append(f"round(CAST({name} AS DOUBLE), {6 if kind == 'f' else int(kind)}) + 0.0 AS {name}")
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    if ctes:
        head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
        body = f"{head.group(0)} {ctes}, {body[head.end():]}" if head else f"WITH {ctes} {body}"
    return f"SELECT {', '.join(out)} FROM ({body}) AS q"


def spark_query(name: str):
    fn, spec, _ = REGISTRY[name]
    return lambda spark, sf_dir: finish(fn(Views(spark, sf_dir)), spec)


def oracle(name: str) -> str | None:
    _, spec, sql = REGISTRY[name]
    return None if sql is None else closed_sql(sql, spec)
