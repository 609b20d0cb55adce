"""Which columns may feed a model: column roles, audits, design tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceworks.checks import require_columns
from sliceworks.functions.numbers import parse_number
from sliceworks.operators.profile import constant_columns, normalized, varying


def policy_audit(
    df: DataFrame, *, allowed: Sequence[str] | None = None,
    forbidden: Mapping[str, str] | Sequence[str] = (), roles: Mapping[str, str] | None = None,
    fit_rows: Column | None = None,
) -> DataFrame:
    """One row per column: role, reason, whether dropped as constant, whether used.

    Roles: the ones given (id, label, target, ...), then forbidden, allowed, missing (allowed but
    absent) and other. Without an allow-list every remaining column is allowed. ``fit_rows``
    restricts the constancy test, to training rows say.
    """

    reasons = dict(forbidden) if isinstance(forbidden, Mapping) else {c: "excluded" for c in forbidden}
    named = dict(roles or {})
    entries = []
    for c in df.columns:
        if c in named:
            role = named[c]
        elif c in reasons:
            role = "forbidden"
        elif allowed is None or c in allowed:
            role = "allowed"
        else:
            role = "other"
        entries.append((c, role, reasons.get(c) if role == "forbidden" else None))
    entries += [(c, "missing", None) for c in (allowed or ()) if c not in df.columns]
    policy = df.sparkSession.createDataFrame(entries, "column string, role string, reason string")
    candidates = [c for c, role, _ in entries if role == "allowed"]
    if candidates:
        rows = df.filter(fit_rows) if fit_rows is not None else df
        policy = policy.join(constant_columns(rows, candidates).drop("row_count"), "column", "left")
    else:
        policy = policy.withColumn("is_constant", F.lit(None).cast("boolean"))
    constant = F.coalesce("is_constant", F.lit(False))
    is_allowed = F.col("role") == "allowed"
    return policy.select(
        "column", "role", "reason", (is_allowed & constant).alias("dropped_as_constant"),
        (is_allowed & ~constant).alias("is_used"),
    )


def classification_design(
    df: DataFrame, *, id_column: str, label: str, excluded: Sequence[str] = ()
) -> DataFrame:
    """Id, label as text, and every other column that is neither excluded nor constant."""

    require_columns(df, [id_column, label])
    features = [c for c in df.columns if c not in {id_column, label, *excluded}]
    return df.select(id_column, F.col(label).cast("string").alias(label), *varying(df, features))


def _numeric_target(df: DataFrame, target: str, by: Sequence[str] = ()) -> Column:
    """Target as double; raises when a value is missing or not a number (per split if given)."""

    value = parse_number(F.col(target), df.schema[target].dataType)
    bad = df.groupBy(*by).agg(F.count_if(value.isNull()).alias("n")).filter("n > 0").collect()
    if bad:
        places = "; ".join(f"{row['n']}" + (f" in {row[by[0]]!r}" if by else "") for row in bad)
        raise ValueError(f"Target column {target!r} has missing or non-numeric values: {places}.")
    return value


def regression_design(
    df: DataFrame, *, id_column: str, target: str, label: str | None = None,
    outcome_columns: Sequence[str] = (), excluded: Sequence[str] = (),
    candidates: Sequence[str] | None = None,
) -> DataFrame:
    """Id, numeric target, and the permitted columns that vary."""

    require_columns(df, [id_column, target, *(candidates or ())])
    banned = {id_column, label, target, *outcome_columns, *excluded}
    features = [c for c in (candidates if candidates is not None else df.columns) if c not in banned]
    used = varying(df, features)
    return df.select(id_column, _numeric_target(df, target).alias(target), *used)


def fixed_split_design(
    df: DataFrame, *, target: str, features: Sequence[str], group: str | None = None,
    strict: bool = False, split_column: str = "split_name", keep: Sequence[str] = (),
    train: DataFrame | None = None,
) -> DataFrame:
    """Inputs of an already split table: columns that vary *in train*, numeric target everywhere.

    ``strict`` casts the target and lets a bad text stop the job (instead of one counted error).
    ``train`` is the train rows of the table where they are held.
    """

    roles = [split_column, *keep, *([group] if group else [])]
    require_columns(df, [target, *features, *roles])
    used = varying(df.filter(F.col(split_column) == "train") if train is None else train, list(features))
    if not used:
        raise ValueError("Every feature column is constant in the train split.")
    value = F.col(target).cast("double") if strict else _numeric_target(df, target, [split_column])
    columns = [F.col(c).cast("string").alias(c) if c == group else F.col(c)
               for c in dict.fromkeys(roles)]
    return df.select(*columns, value.alias(target), *[c for c in used if c not in roles])


def project_roles(
    df: DataFrame, *, features: Sequence[str], targets: Sequence[str], target: str,
    group: str, payload: Sequence[str] = (), drop_payload: bool = True,
) -> dict[str, list[str]]:
    """Column lists of X, y and meta; a target among the features is an error."""

    leaked = sorted(set(features) & set(targets))
    if leaked:
        raise ValueError(f"Target columns among the features: {leaked}")
    require_columns(df, [group, target])
    present = [c for c in df.columns if not (drop_payload and c in payload)]
    return {
        "features": [c for c in features if c in present],
        "target": [target],
        "meta": [c for c in present if c not in features and c not in targets],
    }


def select_roles(df: DataFrame, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """One table holding the columns of all roles."""

    return df.select(*dict.fromkeys(c for columns in roles.values() for c in columns))


def has_nulls(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Per column whether any value is missing."""

    row = df.agg(*[(F.count_if(normalized(df, c).isNull()) > 0).alias(c) for c in columns]).first()
    return row.asDict()
