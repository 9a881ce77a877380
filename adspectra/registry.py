"""Named queries over a folder of tables, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.driver import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Decimals kept of ratios and averages, whose last bits depend on the order of sums.
DECIMALS = 6


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of ``Tables``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, decimals: int = DECIMALS) -> DataFrame:
    """Rounds the named columns; all doubles if none is named."""
    columns = columns or tuple(c for c, kind in df.dtypes if kind == "double")
    return df.withColumns({c: F.round(c, decimals) for c in columns})
