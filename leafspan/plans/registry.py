"""Name -> query and name -> oracle SQL of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafspan.plans import more, pages, words


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonised words in reading order, sanitised and tagged."""
    return pages.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return words.QUERIES | pages.QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    return words.ORACLE | pages.ORACLE | more.ORACLE
