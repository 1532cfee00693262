"""Strategy registry: named books with parameters and an enabled flag; the enabled ones run in one plan."""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Strategy:
    """`book(views, **params)` gives (midx, ret) by return month."""
    name: str
    book: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    enabled: bool = True


def run_enabled(views, registry: list[Strategy]) -> DataFrame:
    """(id, midx, ret) of every enabled strategy.  Names are unique."""
    names = [s.name for s in registry]
    if len(set(names)) < len(names):
        raise ValueError("a name is registered twice")
    out = None
    for s in registry:
        if s.enabled:
            d = s.book(views, **s.params).select(F.lit(s.name).alias("id"), "midx", "ret")
            out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no strategy is enabled")
    return out


def catalogue(spark, registry: list[Strategy]) -> DataFrame:
    """(name, params, digest, enabled): parameters as sorted JSON and their hash."""
    d = spark.createDataFrame([(s.name, json.dumps(s.params, sort_keys=True, separators=(",", ":")), s.enabled) for s in registry], "name string, params string, enabled boolean")
    return d.withColumn("digest", F.substring(F.sha2("params", 256), 1, 12))
