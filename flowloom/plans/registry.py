"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with its SQL when it has one."""
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round double columns (sums of doubles differ in the last bits between engines) and drop a minus zero."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
