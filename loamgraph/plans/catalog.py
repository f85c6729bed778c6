"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry


def _load() -> None:
    package = importlib.import_module("loamgraph.plans")
    for found in pkgutil.iter_modules(package.__path__):
        if found.name.startswith("q_"):
            importlib.import_module(f"loamgraph.plans.{found.name}")


_load()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["er_pipeline"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
