"""Registry of the queries and what they share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelaws.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder: in the shared one of the session where it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/run-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="run-")


def new_store(spark: SparkSession) -> tuple[Store, str]:
    """A store with a database of its own."""
    database = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch(spark)}'")
    return Store(spark), database


def sig(column: Column | str, digits: int = 6) -> Column:
    """Significant digits that two engines agree on for floating-point results.

    Six after sums and logarithms. Nine for plain interpolations of two-decimal data, which six
    would leave on rounding ties.
    """
    c = F.col(column) if isinstance(column, str) else column
    return F.format_string(f"%.{digits - 1}e", c.cast("double")).try_cast("double")


def sqlsig(expression: str, digits: int = 6) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def rounded(df: DataFrame, exact: tuple[str, ...], digits: int = 6) -> DataFrame:
    """Every column but the exact ones to significant digits."""
    return df.select(*(F.col(f"`{c}`") if c in exact else sig(f"`{c}`", digits).alias(c) for c in df.columns))
