"""Registry of named queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the modules registers their queries
    from synthlab.plans import (  # noqa: F401
        q_prep, q_sampling, q_stats, q_report, q_generate, q_fidelity, q_models, q_sources, q_loaders, q_wide, loaders,
    )
    return REGISTRY
