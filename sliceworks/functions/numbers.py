"""Number and time parsing, one notion of missing, safe ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV cell may hold for "missing" (the pandas reader defaults).
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: what counts as a number in text (Spark's own cast also takes 1.0d and 1f).
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def blank_markers_to_null(text: Column, markers: Sequence[str] = MISSING_MARKERS) -> Column:
    """Null for every marker of a missing CSV cell."""

    return F.when(~text.isin(*markers), text)


def nan_to_null(number: Column) -> Column:
    """NaN is missing, and missing is null."""

    return F.when(~F.isnan(number), number)


def parse_number(column: Column, data_type: T.DataType | None = None) -> Column:
    """Text or number to double; null where that is impossible."""

    if data_type is not None and isinstance(data_type, T.NumericType):
        return nan_to_null(column.cast("double"))
    if data_type is not None and isinstance(data_type, T.BooleanType):
        return column.cast("double")
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def parse_timestamp(column: Column, data_type: T.DataType | None = None) -> Column:
    """ISO 8601 text to timestamp (session zone UTC); null where that is impossible."""

    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp")
    return F.trim(column.cast("string")).try_cast("timestamp")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``a / b``; 0 when ``b`` is zero, null or NaN."""

    top, bottom = numerator.cast("double"), denominator.cast("double")
    unusable = bottom.isNull() | F.isnan(bottom) | (bottom == 0)
    return F.when(unusable, F.lit(0.0)).otherwise(top / bottom)


def or_zero(column: Column) -> Column:
    """Null and NaN count as 0."""

    return F.coalesce(nan_to_null(column.cast("double")), F.lit(0.0))
