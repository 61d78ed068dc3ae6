"""Where queries and their SQL twins are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a function of (spark, sf_dir) under a name, with its SQL where SQL can say it."""

    def enter(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return enter


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles as they are compared: rounded, and without a negative zero."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits) + 0.0)
    return df


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"
