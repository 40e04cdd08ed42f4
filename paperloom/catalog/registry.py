"""The registered queries: a Spark callable, its survey row and, where possible, a SQL twin."""

from __future__ import annotations

import re
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.tables import read_table


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None = None):
    def keep(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(build, covers, sql)
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str, spread: str | None = None) -> DataFrame:
    """A given table; ``spread`` names the key to use when the files have too few splits."""
    return read_table(spark, f"{folder}/{name}.parquet", spread)


def with_ctes(*parts: str, select: str, once: bool = False) -> str:
    """Join named SQL parts (each ``name AS (...)``) into one statement; ``once`` computes each part a single time."""
    if once:
        parts = tuple(re.sub(r"^(\s*\w+(?:\([^)]*\))?) AS \(", r"\1 AS MATERIALIZED (", part) for part in parts)
    return "WITH RECURSIVE " + ",\n".join(part.strip() for part in parts) + "\n" + select.strip()
