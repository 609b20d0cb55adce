"""Categories of any number: checked lists where they are few, a joined code table where they are many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sliceworks.checks import fresh_name, require_columns
from sliceworks.operators.ordering import if_small
from sliceworks.session import written

#: Categories that may become column names, slots with a name, or entries of a list on the driver.
MOST_CATEGORIES = 100_000


def few_rows(df: DataFrame, what: str, most: int = MOST_CATEGORIES) -> list[Row]:
    """The rows of a table that must be short; one row past the limit is an error, and no more of them
    are ever fetched."""

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"There are more than {most} {what}; encode them with a code table instead.")
    return rows


def category_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``category``, ``code`` (0.. in order of the text, by column) and ``category_rows``.

    Ranges of categories are numbered where they lie and shifted by the number of those before, so
    no task orders a whole column and nothing but the ranges' sizes is added up.
    """

    require_columns(train, columns)
    counts = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "category").filter("category is not null").groupBy(
        "column", "category").agg(F.count(F.lit(1)).alias("category_rows"))
    ranges = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written with their range and place, so that a task that runs again cannot change them
    placed = written(counts.repartitionByRange(ranges, "column", "category").sortWithinPartitions(
        "column", "category").withColumn("_place", F.monotonically_increasing_id()), "categories").withColumn(
        "_range", F.shiftright("_place", 33))
    sizes = placed.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(if_small(starts), ["column", "_range"]).select(
        "column", "category", (F.col("_before") + F.col("_place") - F.col("_first")).alias("code"),
        "category_rows")


def with_codes(df: DataFrame, codes: DataFrame, column: str, output: str) -> DataFrame:
    """The code of each row's category; null where it is null or unseen. The table is broadcast once it
    is known to be small; else both sides are shuffled and a hot category is split."""

    key = fresh_name(df, "_category")
    table = if_small(codes.filter(F.col("column") == column).select(
        F.col("category").alias(key), F.col("code").alias(output)))
    return df.join(table, F.col(column).cast("string") == F.col(key), "left").drop(key)


def sparse_one_hot(df: DataFrame, codes: DataFrame, column: str, output: str) -> DataFrame:
    """A sparse vector with one slot per category in place of a column each; all zeros for null or
    unseen."""

    size = codes.filter(F.col("column") == column).count()
    code = fresh_name(df, "_code")
    coded = with_codes(df, codes, column, code).withColumn(
        code, F.coalesce(F.col(code), F.lit(size)).cast("double")).withMetadata(
        code, {"ml_attr": {"type": "nominal", "num_vals": size + 1}})
    # the last code, for unknown, is the one whose slot is dropped
    encoder = OneHotEncoder(inputCols=[code], outputCols=[output], dropLast=True)
    return encoder.fit(coded).transform(coded).drop(code)
