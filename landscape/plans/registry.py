"""Registry of named queries: key -> (spark, sf_dir) -> DataFrame, plus the
independent DuckDB oracle SQL for the SQL-expressible ones.

Query modules register with ``@query(key, oracle=SQL)``. Output conventions
shared with the oracles: floats rounded to 6 places, counts BIGINT, lists
as sorted comma-joined strings, dates as ISO strings.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    fn: QueryFn
    oracle: Optional[str]
    group: str


_REGISTRY: dict[str, Entry] = {}

MODULES = [
    "entities", "novelty", "indicators", "dashboards", "naming", "graph",
    "clusters", "edits", "validation", "journals", "rollups", "ingest", "simulations",
]


def query(key: str, oracle: Optional[str] = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = Entry(key, fn, oracle, fn.__module__.rsplit(".", 1)[-1])
        return fn
    return wrap


def load_all() -> dict[str, Entry]:
    for m in MODULES:
        try:
            importlib.import_module(f"{__package__}.q_{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__package__}.q_{m}":
                raise
    return dict(_REGISTRY)


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    # keyed by the running application (not id(spark), which Python may reuse
    # for a new session after the old one is gone)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for output as round(x * 10^d) / 10^d in double arithmetic (the
    way DuckDB rounds doubles), so exact binary ties come out the same in both
    engines."""
    col = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(col * F.lit(m), 0) / F.lit(m)


def joined(c: str | Column) -> Column:
    """Sorted, comma-joined list."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(col), ",")


def finish(df: DataFrame, floats: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    out = df
    for c in floats:
        out = out.withColumn(c, r6(c))
    for c in lists:
        out = out.withColumn(c, joined(c))
    return out
