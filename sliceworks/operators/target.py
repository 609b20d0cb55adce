"""Constructed targets, their summaries, and the checked join of features to targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceworks.checks import require_columns
from sliceworks.functions.bits import bit_errors
from sliceworks.operators.ordering import exact_quantiles
from sliceworks.operators.profile import varying


def _or_raise(ok: Column, value: Column, message: Column) -> Column:
    """The value, or an error that stops the job when the row fails the test."""

    return F.when(ok, value).otherwise(F.raise_error(message).cast("double"))


def agreement_target(
    df: DataFrame, *, id_column: str, length: str, observed: str, ideal: str,
    target: str = "reliability",
) -> DataFrame:
    """Id, bit errors and ``1 - errors / length``; a bad row stops the job when it is read."""

    require_columns(df, [id_column, length, observed, ideal])
    key = F.col(id_column).cast("string")
    errors, size = bit_errors(F.col(observed), F.col(ideal)), F.col(length).cast("int")
    ratio = 1.0 - errors.cast("double") / size.cast("double")
    checked = (
        F.when(size.isNull() | (size <= 0),
               F.raise_error(F.concat(F.lit("Length is not positive for "), key)).cast("double"))
        .when(errors.isNull(),
              F.raise_error(F.concat(F.lit("Bit errors are undefined for "), key)).cast("double"))
        .otherwise(_or_raise((ratio >= 0) & (ratio <= 1), ratio,
                             F.concat(F.lit("Target fell outside [0, 1] for "), key)))
    )
    return df.select(key.alias(id_column), errors.alias("bit_errors"), checked.alias(target))


def target_summary(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows, extremes, mean and exact median of each column; raises on a missing value."""

    require_columns(df, targets)
    numbers = df.select(*[F.col(t).cast("double").alias(t) for t in targets])
    missing = numbers.agg(
        F.count(F.lit(1)).alias("total rows"),
        *[F.count_if(F.col(t).isNull() | F.isnan(t)).alias(t) for t in targets]).first()
    for t in targets:
        if missing[t]:
            raise ValueError(f"Target column {t!r} contains {missing[t]} missing values.")
    medians = exact_quantiles(numbers, {t: (0.5,) for t in targets})
    rows = F.array(*[
        F.struct(F.lit(t).alias("target"), F.count(F.lit(1)).alias("row_count"),
                 F.min(t).alias("target_min"), F.max(t).alias("target_max"),
                 F.avg(t).alias("target_mean"),
                 F.lit(medians[t][0]).cast("double").alias("target_median"))
        for t in targets
    ])
    return numbers.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def join_target(features: DataFrame, targets: DataFrame, *, id_column: str, target: str) -> DataFrame:
    """Add the target to every feature row by id.

    A repeated id among the targets or a feature row without a target stops the job. Both tests
    ride on the join itself: the targets are collapsed per id, which also keys them for the join,
    so no extra pass is needed.
    """

    require_columns(features, [id_column])
    require_columns(targets, [id_column, target])
    key = F.col(id_column).cast("string")
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(
        F.lit("Duplicate target id "), F.coalesce(F.first(key), F.lit("null")))).cast("double"))
    per_id = targets.groupBy(key.alias("_key")).agg(
        once.otherwise(F.first(target).cast("double")).alias("_target"))
    joined = features.withColumn("_key", key).join(per_id, "_key", "left")
    value = F.when(F.col("_target").isNotNull(), F.col("_target")).otherwise(F.raise_error(
        F.concat(F.lit("No target for id "), F.coalesce("_key", F.lit("null")))).cast("double"))
    return joined.withColumn(target, value).drop("_key", "_target")


def target_design(
    features: DataFrame, targets: DataFrame, *, id_column: str, target: str,
    allowed: Sequence[str],
) -> DataFrame:
    """Id, the allowed columns that vary, and the joined target."""

    present = [c for c in allowed if c in features.columns]
    if not present:
        raise ValueError("The feature table holds none of the allowed columns.")
    used = varying(features, present)
    if not used:
        raise ValueError("Every allowed column is constant.")
    return join_target(features.select(id_column, *used), targets, id_column=id_column,
                       target=target)
