"""A query is a function of (spark, directory) with, where SQL can express it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree; minus zero becomes zero."""
    return df.select(*((F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))


def register(name: str, query: Query, oracle: str | None = None, digits: int = 6) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, d: rounded(query(spark, d), digits)
    if oracle:
        SQL[name] = oracle


def r(names: str) -> str:
    """SQL for columns rounded to six digits: ``a b`` gives ``round(a,6) a, round(b,6) b``."""
    return ", ".join(f"round({n},6) {n}" for n in names.split())
