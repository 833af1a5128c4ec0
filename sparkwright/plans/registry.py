"""All registered plans: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "sparkwright.plans.retail",
    "sparkwright.plans.manufacturing",
    "sparkwright.plans.logistics",
    "sparkwright.plans.finance",
    "sparkwright.plans.generic",
    "sparkwright.plans.prepare",
    "sparkwright.plans.profile",
    "sparkwright.plans.quality",
    "sparkwright.plans.matching",
    "sparkwright.plans.summary",
    "sparkwright.plans.io",
]


def _load():
    qs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for key, fn in mod.QUERIES.items():
            if key in qs:
                raise ValueError(f"duplicate query id {key}")
            qs[key] = fn
        oracle.update(getattr(mod, "ORACLE", {}))
    return qs, oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _load()[0]


def oracle_sql() -> dict[str, str]:
    return _load()[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.plans.retail import QUERIES
    return QUERIES["retail_monthly_revenue"](spark, sf_dir)
