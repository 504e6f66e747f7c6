"""Named queries over a data folder, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, files, fixtures, lineage, search

_MODULES = (lineage, catalogue, search, files, fixtures)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
