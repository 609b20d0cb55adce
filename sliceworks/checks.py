"""Column presence checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise when a required column is absent."""

    missing = [column for column in required if column not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name derived from ``wanted`` that ``df`` does not use yet."""

    name = wanted
    while name in df.columns:
        name = f"_{name}"
    return name
