"""Registered queries over the driver's tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""

    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round columns, so that the order of summation cannot show."""

    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def bits(column: str | Column, width: int | None = None) -> Column:
    """Binary text of an integer, zero-padded to a width if shorter; never cut."""

    text = F.bin(column)
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")) if width else text
