"""All registered queries as functions of a session and a folder of source tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buylens.sources import purchasing_tables

GROUPS = ["rules", "validation", "graph", "analytics", "features", "usecases", "ml", "streaming"]


def plans() -> dict[str, Callable]:
    """Query name to a function of the purchasing tables."""
    out: dict[str, Callable] = {}
    for group in GROUPS:
        module = importlib.import_module(f"buylens.plans.{group}")
        overlap = out.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        out.update(module.QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, source_dir: plan(purchasing_tables(spark, source_dir))
    return {name: bind(plan) for name, plan in plans().items()}
