"""Row features from tokens, bit strings and ratios; nested feature tables; encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceworks.checks import require_columns
from sliceworks.functions.bits import bit_errors
from sliceworks.functions.numbers import or_zero, safe_ratio
from sliceworks.functions.tokens import count_distinct_tokens, count_token, parse_tokens, share_in_set
from sliceworks.operators.categories import few_rows


@dataclass(frozen=True)
class SequenceColumns:
    """Which columns play which part, and the token settings."""

    sequence: str
    depth: str
    length: str
    relaxation: str
    coherence: str
    observed: str
    ideal: str
    delimiters: Sequence[str] = (",", ";", "|", "->")
    counted_token: str = "cx"
    token_set: Sequence[str] = ("cx", "cz", "swap")


def add_sequence_features(df: DataFrame, columns: SequenceColumns) -> DataFrame:
    """Seven features; missing numbers count as 0. Unaligned bits serve if aligned are absent."""

    observed = _aligned_or_raw(df, columns.observed)
    ideal = _aligned_or_raw(df, columns.ideal)
    errors = bit_errors(observed, ideal)
    tokens = F.col("_tokens")
    length = or_zero(F.col(columns.length))
    return (
        df.withColumn("_tokens", parse_tokens(F.col(columns.sequence), columns.delimiters))
        .withColumns({
            "num_cx": count_token(tokens, columns.counted_token).cast("double"),
            "two_qubit_ratio": share_in_set(tokens, columns.token_set),
            "unique_gates": count_distinct_tokens(tokens).cast("double"),
            "t2_t1_ratio": safe_ratio(or_zero(F.col(columns.coherence)),
                                      or_zero(F.col(columns.relaxation))),
            "bit_errors": F.coalesce(errors.cast("double"), F.lit(0.0)),
        })
        .withColumns({
            "cx_density": safe_ratio(F.col("num_cx"), or_zero(F.col(columns.depth))),
            "observed_error_rate": safe_ratio(F.col("bit_errors"), length),
        })
        .drop("_tokens")
    )


def _aligned_or_raw(df: DataFrame, name: str) -> Column:
    if name not in df.columns and name.endswith("_aligned"):
        name = name.removesuffix("_aligned")
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def add_ratio_features(
    df: DataFrame, *, length: str, depth: str, gate_error: str, readout_error: str,
    relaxation: str, coherence: str, fidelity: str, errors: str = "bit_errors",
) -> DataFrame:
    """Seven normalised features; missing numbers count as 0."""

    value = lambda name: or_zero(F.col(name))
    return df.withColumns({
        "depth_per_qubit": safe_ratio(value(depth), value(length)),
        "error_depth_load": value(gate_error) * value(depth),
        "readout_to_gate_error_ratio": safe_ratio(value(readout_error), value(gate_error)),
        "coherence_gap": value(relaxation) - value(coherence),
        "coherence_min": F.least(value(relaxation), value(coherence)),
        "fidelity_loss": F.greatest(F.lit(0.0), 1.0 - value(fidelity)),
        "bit_error_density": safe_ratio(value(errors), value(depth)),
    })


SEQUENCE_FEATURES = ("num_cx", "two_qubit_ratio", "unique_gates", "cx_density", "t2_t1_ratio",
                     "bit_errors", "observed_error_rate")
RATIO_FEATURES = ("depth_per_qubit", "error_depth_load", "readout_to_gate_error_ratio",
                  "coherence_gap", "coherence_min", "fidelity_loss", "bit_error_density")


def nested_feature_tables(
    df: DataFrame, *, id_column: str, label_column: str, base_columns: Sequence[str],
    sequence: SequenceColumns, gate_error: str, readout_error: str, fidelity: str,
) -> dict[str, DataFrame]:
    """Three tables, each holding the columns of the one before: raw, topology, enhanced."""

    base = [id_column, label_column, *base_columns]
    require_columns(df, [*base, sequence.sequence])
    full = add_ratio_features(
        add_sequence_features(df, sequence), length=sequence.length, depth=sequence.depth,
        gate_error=gate_error, readout_error=readout_error, relaxation=sequence.relaxation,
        coherence=sequence.coherence, fidelity=fidelity,
    )
    return {
        "baseline_raw": full.select(*base),
        "topology_aware": full.select(*base, *SEQUENCE_FEATURES),
        "enhanced_topology": full.select(*base, *SEQUENCE_FEATURES, *RATIO_FEATURES),
    }


def fit_categories(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted category list per column. The lists become column names, so they must be short; see
    ``categories.sparse_one_hot`` for long ones."""

    pairs = few_rows(train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "category"
    ).filter("category is not null").distinct(), "categories")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in sorted(pairs):
        found[row["column"]].append(row["category"])
    return found


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each string column by 0/1 doubles; null or an unseen text gives all zeros."""

    flags = {
        f"{column}_{value}": F.coalesce((F.col(column).cast("string") == value), F.lit(False))
        .cast("double")
        for column, values in categories.items()
        for value in values
    }
    return df.withColumns(flags).drop(*categories)


def fit_label_codes(df: DataFrame, label: str, code: str) -> StringIndexerModel:
    """Codes 0..k-1 in alphabetical order of the label text."""

    few_rows(df.select(label).distinct(), f"labels in {label!r}")
    return StringIndexer(inputCol=label, outputCol=code, stringOrderType="alphabetAsc").fit(df)


def decode_labels(df: DataFrame, codes: StringIndexerModel, code: str, label: str) -> DataFrame:
    """Label text from its code."""

    return IndexToString(inputCol=code, outputCol=label, labels=codes.labels).transform(df)
