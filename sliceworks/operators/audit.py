"""Split audits: overlap of groups, repeated row ids, target ranges, degenerate columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.checks import require_columns
from sliceworks.operators.profile import duplicate_rows, normalized
from sliceworks.operators.splits import SPLITS


class SplitAudit(NamedTuple):
    """Per split: rows, groups, repeated ids. Per overlap: the two splits and the group."""

    counts: DataFrame
    overlaps: DataFrame


def group_overlaps(
    df: DataFrame, group: str, splits: Sequence[str] = SPLITS, *, nulls: bool = True
) -> DataFrame:
    """Groups found in two splits, one row per pair of splits. ``nulls`` as a group or not."""

    require_columns(df, [group, "split_name"])
    rows = df if nulls else df.filter(normalized(df, group).isNotNull())
    flags = rows.groupBy(F.col(group).cast("string").alias("group_value")).agg(
        *[F.max(F.col("split_name") == s).alias(f"_{i}") for i, s in enumerate(splits)])
    pairs = F.filter(
        F.array(*[
            F.when(F.col(f"_{i}") & F.col(f"_{j}"),
                   F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split")))
            for (i, a), (j, b) in combinations(enumerate(splits), 2)
        ]),
        lambda p: p.isNotNull(),
    )
    return flags.select("group_value", F.explode(pairs).alias("p")).select("p.*", "group_value")


def audit_splits(
    df: DataFrame, group: str, row_ids: Sequence[str], splits: Sequence[str] = SPLITS
) -> SplitAudit:
    """Rows, groups and repeated ids per split, and every overlapping group."""

    require_columns(df, [group, "split_name", *row_ids])
    per_group = df.groupBy("split_name", F.coalesce(F.col(group).cast("string"), F.lit("null"))
                           .alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sizes = per_group.groupBy("split_name").agg(
        F.sum("n").alias("row_count"), F.count("g").alias("group_count"))
    repeated = duplicate_rows(df, row_ids, by=["split_name"])
    counts = sizes.join(repeated, "split_name")
    return SplitAudit(counts, group_overlaps(df, group, splits))


def assert_split_integrity(
    df: DataFrame, group: str, row_ids: Sequence[str], splits: Sequence[str] = SPLITS
) -> SplitAudit:
    """The audit; raises when a group is in two splits or an id repeats within one."""

    audit = audit_splits(df, group, row_ids, splits)
    leaks = audit.overlaps.groupBy("left_split", "right_split").count().collect()
    repeated = audit.counts.filter("duplicate_rows > 0").collect()
    if leaks or repeated:
        pairs = {f"{r['left_split']}__{r['right_split']}": r["count"] for r in leaks}
        ids = {r["split_name"]: r["duplicate_rows"] for r in repeated}
        raise ValueError(f"Duplicate ids within splits {ids}; groups in two splits at once {pairs}.")
    return audit


def split_checks(
    df: DataFrame, *, targets: Sequence[str], features: Sequence[str],
    optional_targets: Sequence[str] = (), varying_target: str | None = None,
) -> DataFrame:
    """One row per check and split: targets in [0, 1] and not wholly null, the train target
    varies, no train feature is wholly null. One aggregate per split serves all checks."""

    require_columns(df, ["split_name", *targets, *features])
    value = {c: normalized(df, c) for c in [*targets, *features]}
    number = {c: value[c].cast("double") for c in targets}
    is_train = F.col("split_name") == "train"
    checks = []
    for c in targets:
        outside = F.count_if((number[c] < 0) | (number[c] > 1))
        filled = F.count(number[c])
        passed = (outside == 0) & ((filled > 0) | F.lit(c in optional_targets))
        checks.append(("target_range", c, passed, outside, F.lit(True)))
    if varying_target:
        spread = F.var_samp(number[varying_target])
        passed = F.coalesce(spread > 0, F.lit(False))
        checks.append(("target_varies", varying_target, passed, F.count(number[varying_target]),
                       F.first("split_name") == "train"))
    for c in features:
        filled = F.count(value[c])
        checks.append(("feature_filled", c, filled > 0, filled, F.first("split_name") == "train"))
    structs = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.lit(c).alias("column"), ok.alias("passed"),
                 n.cast("long").alias("measure"), applies.alias("applies"))
        for name, c, ok, n, applies in checks
    ])
    rows = df.groupBy("split_name").agg(structs.alias("checks"))
    return (
        rows.select("split_name", F.explode("checks").alias("c")).select("split_name", "c.*")
        .filter("applies").drop("applies")
    )


def assert_split_checks(checks: DataFrame) -> None:
    """Raise when a check failed."""

    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise ValueError("Split checks failed: " + "; ".join(
            f"{r['check_name']} of {r['column']!r} in {r['split_name']!r} ({r['measure']})"
            for r in failed))
