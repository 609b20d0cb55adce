"""Type coercion and declarative row rules: every row's issues in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.checks import require_columns
from sliceworks.functions.bits import normalize_bits
from sliceworks.functions.numbers import nan_to_null, parse_number, parse_timestamp
from sliceworks.functions.tokens import strip_blanks
from sliceworks.session import written


def _issue(
    issue: str | Column, column: str, condition: str | Column, observed: Column, rule_type: str
) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_column(issue).alias("issue"), F.lit(column).alias("column"),
        as_column(condition).alias("expected_condition"),
        observed.cast("string").alias("observed_value"), F.lit(rule_type).alias("rule_type"),
    )


class Rule(Protocol):
    """A rule yields a struct describing the issue of a row, or null."""

    column: str

    def issue(self) -> Column: ...


@dataclass(frozen=True)
class RangeRule:
    """A number must lie between two bounds, each inclusive or not."""

    column: str
    min_value: float | None = None
    max_value: float | None = None
    inclusive_min: bool = True
    inclusive_max: bool = True

    def in_range(self, value: Column) -> Column:
        """True where a (non-null) value keeps the rule."""

        ok = F.lit(True)
        if self.min_value is not None:
            ok = ok & (value >= self.min_value if self.inclusive_min else value > self.min_value)
        if self.max_value is not None:
            ok = ok & (value <= self.max_value if self.inclusive_max else value < self.max_value)
        return ok

    def expected_condition(self) -> str:
        """The rule in words, such as ``>= 0.0 and <= 1.0``."""

        bounds = [
            f"{strict}{'=' if inclusive else ''} {float(bound)}"
            for strict, inclusive, bound in (
                (">", self.inclusive_min, self.min_value),
                ("<", self.inclusive_max, self.max_value),
            )
            if bound is not None
        ]
        return " and ".join(bounds) or "any numeric value"

    def issue(self) -> Column:
        value = nan_to_null(F.col(self.column).cast("double"))
        condition = self.expected_condition()
        return F.when(
            value.isNull(),
            _issue(f"missing_or_invalid_{self.column}", self.column, f"numeric and {condition}",
                   value, "numeric_range"),
        ).when(
            ~self.in_range(value),
            _issue(f"out_of_range_{self.column}", self.column, condition, value, "numeric_range"),
        )


@dataclass(frozen=True)
class RequiredRule:
    """A text must be present and not blank."""

    column: str

    def issue(self) -> Column:
        value = F.col(self.column).cast("string")
        return F.when(
            value.isNull() | (strip_blanks(value) == ""),
            _issue(f"missing_{self.column}", self.column, "non-empty string", value,
                   "required_value"),
        )


@dataclass(frozen=True)
class PositiveLengthRule:
    """A length must be above zero once truncated to a whole number."""

    column: str

    def issue(self) -> Column:
        value = nan_to_null(F.col(self.column).cast("double"))
        whole = value.try_cast("long")
        return F.when(
            whole.isNull() | (whole <= 0),
            _issue(f"invalid_{self.column}", self.column, "> 0", value, "numeric_range"),
        )


@dataclass(frozen=True)
class TimestampRule:
    """A timestamp must have parsed."""

    column: str

    def issue(self) -> Column:
        return F.when(
            F.col(self.column).isNull(),
            _issue(f"invalid_{self.column}", self.column, "valid ISO8601 timestamp",
                   F.lit(None), "format"),
        )


@dataclass(frozen=True)
class BitStringRule:
    """A bit string must fit a length column; also yields the aligned text and a padding flag."""

    column: str
    length_column: str
    align: bool = True

    @property
    def aligned_column(self) -> str:
        return f"{self.column}_aligned"

    @property
    def padded_column(self) -> str:
        return f"{self.column}_was_padded"

    def _normalized(self):
        length = nan_to_null(F.col(self.length_column).cast("double"))
        return normalize_bits(F.col(self.column), length, align=self.align,
                              length_name=self.length_column)

    def issue(self) -> Column:
        problem = self._normalized().issue
        length = F.coalesce(F.col(self.length_column).try_cast("double").try_cast("int").cast("string"), F.lit("None"))
        condition = F.concat(
            F.lit(f"binary string with length <= {self.length_column} ("), length, F.lit(")")
        )
        return F.when(
            problem.isNotNull(),
            _issue(F.concat(F.lit(f"{self.column}:"), problem), self.column, condition,
                   F.col(self.column), "bitstring"),
        )

    def outputs(self) -> dict[str, Column]:
        bits = self._normalized()
        return {self.aligned_column: bits.aligned, self.padded_column: bits.was_padded}


def coerce_types(
    df: DataFrame, *, string_columns: Sequence[str] = (), numeric_columns: Sequence[str] = (),
    timestamp_column: str | None = None, index_column: str | None = None,
    drop_columns: Sequence[str] = (),
) -> DataFrame:
    """Trim strings, parse numbers and the timestamp, add ``raw_row_index``.

    A distributed scan has no row order: the index is the id column named, or else Spark's
    scan-local increasing id.
    """

    types = {field.name: field.dataType for field in df.schema}
    table = df.drop(*drop_columns)
    changes: dict[str, Column] = {}
    for name in string_columns:
        if name in table.columns and name != timestamp_column:
            changes[name] = strip_blanks(F.col(name).cast("string"))
    for name in numeric_columns:
        if name in table.columns:
            changes[name] = parse_number(F.col(name), types[name])
    if timestamp_column and timestamp_column in table.columns:
        changes[timestamp_column] = parse_timestamp(
            F.col(timestamp_column), types[timestamp_column]
        )
    index = F.col(index_column) if index_column else F.monotonically_increasing_id()
    return table.withColumn("raw_row_index", index).withColumns(changes)


class Prepared(NamedTuple):
    """Checked rows, the two parts of them, and the rules used."""

    checked: DataFrame
    valid: DataFrame
    invalid: DataFrame
    rules: tuple[Rule, ...]


ISSUES = "validation_issues"
CONDITIONS = "validation_expected_conditions"
DETAILS = "validation_issue_details"
IS_VALID = "is_valid_for_modeling"


def check_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the issue array, its two joined texts, the flag and the aligned bit strings."""

    require_columns(df, [rule.column for rule in rules])
    outputs: dict[str, Column] = {}
    for rule in rules:
        if isinstance(rule, BitStringRule):
            outputs.update(rule.outputs())
    details = F.filter(F.array(*[rule.issue() for rule in rules]), lambda x: x.isNotNull())
    condition = lambda d: F.concat(d["column"], F.lit(": "), d["expected_condition"])
    return df.withColumns({**outputs, DETAILS: details}).withColumns({
        ISSUES: F.array_join(F.transform(DETAILS, lambda d: d["issue"]), ";"),
        CONDITIONS: F.array_join(F.transform(DETAILS, condition), ";"),
        IS_VALID: F.size(DETAILS) == 0,
    })


def split_valid(df: DataFrame, rules: Sequence[Rule], *, drop_invalid: bool = True) -> Prepared:
    """Valid and quarantined rows by one shared projection; invalid ones may stay in as well."""

    checked = check_rows(df, rules)
    valid = checked.filter(F.col(IS_VALID)) if drop_invalid else checked
    return Prepared(checked, valid, checked.filter(~F.col(IS_VALID)), tuple(rules))


def issue_rows(checked: DataFrame) -> DataFrame:
    """One row per issue of a checked table."""

    # a plain explode would make the optimizer test the array first, and so run all rules twice
    return checked.select(F.explode_outer(DETAILS).alias("d")).filter("d is not null").select("d.*")


def issue_counts(checked: DataFrame) -> DataFrame:
    """How often each issue occurs."""

    return issue_rows(checked).groupBy("issue").agg(F.count(F.lit(1)).alias("issue_count"))


def validation_summary(prepared: Prepared, source_columns: Sequence[str]) -> DataFrame:
    """Rows read, valid and invalid, missing values per column, padded bit strings: one row each."""

    checked = prepared.checked
    types = {field.name: field.dataType for field in checked.schema}

    def missing(name: str) -> Column:
        column = F.col(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    measures = {
        "rows_read": F.count(F.lit(1)),
        "rows_valid": F.count_if(IS_VALID),
        "rows_invalid": F.count_if(~F.col(IS_VALID)),
        **{f"missing:{c}": F.count_if(missing(c)) for c in source_columns},
        **{f"padded:{r.column}": F.count_if(r.padded_column) for r in prepared.rules
           if isinstance(r, BitStringRule)},
    }
    one_row = checked.agg(*[m.alias(name) for name, m in measures.items()])
    return one_row.unpivot([], list(measures), "measure", "value")


def issue_ranges(checked: DataFrame, samples: int = 5) -> DataFrame:
    """Per issue: count, smallest and largest number seen, a few distinct texts seen.

    The sample takes the first texts in sorted order, which, unlike "first seen", repeats.
    """

    issues = issue_rows(checked)
    numeric = F.col("rule_type") == "numeric_range"
    number = F.when(numeric, F.col("observed_value").cast("double"))
    # one row per issue, condition and text seen, written, so that the rules run once for both results;
    # texts are keys here, as taking the least of them would sort
    seen = written(issues.groupBy("issue", "column", "rule_type", "expected_condition", F.when(
        ~numeric, F.col("observed_value")).alias("observed_text")).agg(
        F.count(F.lit(1)).alias("issue_count"), F.min(number).alias("observed_min"), F.max(number).alias("observed_max")), "issues-seen")
    # the condition names the row's own length for bit strings, so it is no key of the result
    ranges = seen.groupBy("issue", "column", "rule_type").agg(
        F.min("expected_condition").alias("expected_condition"), F.sum("issue_count").alias("issue_count"),
        F.min("observed_min").alias("observed_min"), F.max("observed_max").alias("observed_max"))
    # the rank limit is pushed below the shuffle: each task sends a few texts per issue
    first = Window.partitionBy("issue").orderBy("observed_text")
    texts = (
        seen.filter("observed_text is not null").select("issue", "observed_text").distinct()
        .withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= samples)
        .groupBy("issue")
        .agg(F.sort_array(F.collect_list("observed_text")).alias("sample_observed_values"))
    )
    return ranges.join(texts, "issue", "left").withColumn(
        "sample_observed_values",
        F.coalesce("sample_observed_values", F.array().cast("array<string>")),
    )
