"""Queries and oracle SQL of the training-data operators, one module per problem."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import leafspan.llm as package


def _modules():
    return [importlib.import_module(f"{package.__name__}.{m.name}") for m in pkgutil.iter_modules(package.__path__) if re.match(r"p\d+_", m.name)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
