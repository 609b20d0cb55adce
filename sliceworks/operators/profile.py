"""Profiles: distributions, missing and constant columns, histograms, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.checks import require_columns
from sliceworks.functions.tokens import normalize_tokens, parse_tokens, raw_tokens
from sliceworks.operators.ordering import exact_quantiles


def normalized(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""

    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Counts of each value as text, most frequent first, ties by value."""

    counts = (
        df.groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("value_count"))
        .orderBy(F.desc("value_count"), F.asc_nulls_first("value"))
    )
    return counts.limit(limit) if limit else counts


def with_tokens(df: DataFrame, sequence: str, delimiters: Sequence[str]) -> DataFrame:
    """Add the token array as ``tokens``."""

    return df.withColumn("tokens", parse_tokens(F.col(sequence), delimiters))


def top_sequences(tokenized: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent normalised sequences."""

    joined = tokenized.select(F.array_join("tokens", ",").alias("sequence"))
    return (
        joined.groupBy("sequence").agg(F.count(F.lit(1)).alias("sequence_count"))
        .orderBy(F.desc("sequence_count"), "sequence").limit(limit)
    )


def token_count_summary(tokenized: DataFrame) -> DataFrame:
    """Fewest, most and mean tokens per row, non-empty rows, distinct sequences."""

    size = F.size("tokens")
    return tokenized.agg(
        F.coalesce(F.min(size), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_tokens"),
        F.round(F.coalesce(F.avg(size), F.lit(0.0)), 4).alias("mean_tokens"),
        F.count_if(size > 0).alias("non_empty_rows"),
        F.countDistinct(F.md5(F.array_join("tokens", ","))).alias("distinct_sequences"),
    )


def token_frequencies(df: DataFrame, sequence: str, delimiters: Sequence[str]) -> DataFrame:
    """How often each token occurs over all rows.

    Pieces are counted as they stand, combined in the tasks, and only different ones are normalised.
    """

    # explode would make the optimizer test the array first, and so cut every text twice
    pieces = df.select(F.explode_outer(raw_tokens(F.col(sequence), delimiters)).alias("piece")).filter(
        "piece is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # few bytes but much work: as many tasks as the session deals a shuffle into
    spread = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # taken out of an array, as a test of the token would be moved to every piece before it is counted
    tokens = spread.select(F.explode_outer(F.filter(
        normalize_tokens(F.array("piece")), lambda t: t != "")).alias("token"), "n")
    return tokens.filter("token is not null").groupBy("token").agg(F.sum("n").alias("token_count"))


def dataset_profile(
    df: DataFrame, *, label: str, length: str, sequence: str, delimiters: Sequence[str],
    feature_tables: Mapping[str, DataFrame], not_features: Sequence[str],
) -> DataFrame:
    """The whole profile as one long table: section, item, value."""

    tokenized = with_tokens(df, sequence, delimiters)
    text = lambda c: F.col(c).cast("string")

    def section(name: str, table: DataFrame, item: str, value: str) -> DataFrame:
        return table.select(F.lit(name).alias("section"), text(item).alias("item"),
                            text(value).alias("value"))

    sizes = token_count_summary(tokenized)
    parts = [
        section("label_distribution", value_counts(df, label), "value", "value_count"),
        section("length_distribution", value_counts(df, length), "value", "value_count"),
        section("token_frequencies", token_frequencies(df, sequence, delimiters), "token", "token_count"),
        section("top_sequences", top_sequences(tokenized), "sequence", "sequence_count"),
        section("token_counts", sizes.select(*[text(c).alias(c) for c in sizes.columns]).unpivot(
            [], sizes.columns, "item", "value"), "item", "value"),
        *[section(f"constant_columns:{name}",
                  constant_columns(table, [c for c in table.columns if c not in not_features])
                  .filter("is_constant"), "column", "row_count")
          for name, table in feature_tables.items()],
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def constant_measures(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Per column an aggregate that is true when it has one value; null counts as a value.

    Smallest = largest and no nulls, or nothing but nulls: one combining pass, no distinct count.
    """

    measures = {}
    for c in columns:
        value = normalized(df, c)
        filled = F.count(value)
        measures[c] = (filled == 0) | (
            (filled == F.count(F.lit(1))) & (F.min(value) == F.max(value))
        )
    return measures


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: the table's row count and whether the column is constant."""

    one_row = df.agg(F.count(F.lit(1)).alias("row_count"),
                     *[m.alias(c) for c, m in constant_measures(df, columns).items()])
    return one_row.unpivot(["row_count"], list(columns), "column", "is_constant")


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that are not constant, in the given order."""

    if not columns:
        return []
    row = df.agg(*[m.alias(c) for c, m in constant_measures(df, columns).items()]).first()
    return [c for c in columns if not row[c]]


def feature_report(tables: Mapping[str, DataFrame], not_features: Sequence[str]) -> DataFrame:
    """Per feature table: rows, feature columns, names of constant columns."""

    result = None
    for name, table in tables.items():
        features = [c for c in table.columns if c not in not_features]
        constant = F.filter(
            F.array(*[F.when(m, F.lit(c)) for c, m in constant_measures(table, features).items()]),
            lambda x: x.isNotNull(),
        )
        row = table.agg(F.count(F.lit(1)).alias("row_count"), constant.alias("constant_columns"))
        row = row.select(F.lit(name).alias("table_name"), "row_count",
                         F.lit(len(features)).alias("feature_column_count"), "constant_columns")
        result = row if result is None else result.unionByName(row)
    return result


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing values, distinct values (null is not a value).

    Values are counted per column first, so a value that fills a third of a column is combined
    before the shuffle.
    """

    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def text(field: T.StructField) -> Column:
        # texts and nested values are told apart by their digest, so that they need not be shuffled
        value = normalized(df, field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # -0.0 is no value of its own
        if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType)):
            return value.cast("string")
        return F.md5(value.cast("string"))

    as_text = df.select(*[text(f).alias(f.name) for f in df.schema])
    counts = (
        as_text.unpivot([], df.columns, "column", "value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    type_of = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("distinct_count"),
    ).withColumn("data_type", type_of[F.col("column")])


def missing_by_column(df: DataFrame, limit: int | None = None, only_missing: bool = False) -> DataFrame:
    """Missing values per column, most first."""

    one_row = df.agg(*[F.count_if(normalized(df, c).isNull()).alias(c) for c in df.columns])
    table = one_row.unpivot([], df.columns, "column", "missing_count")
    if only_missing:
        table = table.filter("missing_count > 0")
    table = table.orderBy(F.desc("missing_count"), "column")
    return table.limit(limit) if limit else table


def overview(df: DataFrame, label: str, length: str | None = None) -> DataFrame:
    """Exploration summary as a long table: sizes, top-20 missing, top-20 labels, lengths."""

    def section(name: str, table: DataFrame, item: str, value: str) -> DataFrame:
        return table.select(F.lit(name).alias("section"), F.col(item).alias("item"),
                            F.col(value).cast("long").alias("value"))

    sizes = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    ).unpivot([], ["row_count", "column_count"], "item", "value")
    result = section("size", sizes, "item", "value")
    result = result.unionByName(
        section("missing_top_20", missing_by_column(df, 20), "column", "missing_count"))
    result = result.unionByName(
        section("label_top_20", value_counts(df, label, 20), "value", "value_count"))
    if length and length in df.columns:
        result = result.unionByName(
            section("length_distribution", value_counts(df, length), "value", "value_count"))
    return result


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed; empty bins are left out.

    A constant column spans its value plus and minus one half.
    """

    value = normalized(df, column)
    bounds = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, high = bounds
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((value - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (
        df.select(number.alias("bin")).filter("bin is not null")
        .groupBy("bin").agg(F.count(F.lit(1)).alias("bin_count"))
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
                (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "bin_count")
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each key (per ``by`` when given). Null keys equal each other."""

    require_columns(df, [*keys, *by])
    extra = [k for k in keys if k not in by]
    counts = df.groupBy(*by, *extra).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe(df: DataFrame, columns: Sequence[str], *, round_to: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""

    numbers = df.select(*[normalized(df, c).cast("double").alias(c) for c in columns])
    quartiles = exact_quantiles(numbers, {c: (0.25, 0.5, 0.75) for c in columns})
    digits = (lambda x: F.round(x, round_to)) if round_to is not None else (lambda x: x)
    measures = {
        "value_count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp,
        "min": F.min, "max": F.max,
        "q25": lambda c: F.lit(quartiles[c][0]).cast("double"),
        "q50": lambda c: F.lit(quartiles[c][1]).cast("double"),
        "q75": lambda c: F.lit(quartiles[c][2]).cast("double"),
    }
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[digits(m(c)).alias(n) for n, m in measures.items()])
        for c in columns
    ])
    return numbers.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def split_overview(
    df: DataFrame, group: str, *, target: str | None = None, split_column: str = "split_name"
) -> DataFrame:
    """Per split: rows, groups, and the target's mean and extremes.

    Rows are combined per group first, so the distinct count needs no second expansion.
    """

    target_value = normalized(df, target).cast("double") if target else F.lit(None).cast("double")
    per_group = df.groupBy(split_column, group).agg(
        F.count(F.lit(1)).alias("n"), F.count(target_value).alias("filled"),
        F.sum(target_value).alias("total"),
        F.min(target_value).alias("low"), F.max(target_value).alias("high"),
    )
    return per_group.groupBy(split_column).agg(
        F.sum("n").alias("row_count"), F.count(group).alias("group_count"),
        (F.sum("total") / F.sum("filled")).alias("target_mean"),
        F.min("low").alias("target_min"), F.max("high").alias("target_max"),
    )


def variant_counts(df: DataFrame, variant: str, split_column: str = "split_name") -> DataFrame:
    """Rows per split and variant."""

    return df.groupBy(split_column, variant).agg(F.count(F.lit(1)).alias("row_count"))
