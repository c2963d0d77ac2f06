"""All named queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

from rollmill import plans
from rollmill.plans.registry import Registry


@lru_cache(maxsize=1)
def registry() -> Registry:
    """What the modules ``q_*`` of this package register."""
    own = Registry()
    for module in sorted(m.name for m in iter_modules(plans.__path__) if m.name.startswith("q_")):
        import_module(f"rollmill.plans.{module}").register(own)
    return own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry().queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry().sql)
