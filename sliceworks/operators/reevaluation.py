"""All diagnostics of a saved suite of runs, from its prediction files alone.

The predictions are read once: one aggregation with grouping sets gives the metrics and error sums of
every run, split and slice. That table has one row per slice value and run; it is written, and everything else
(comparison, error shares, variant gaps, worst slices, winners, gain) is worked out from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceworks.operators.slices import (
    RUN_KEYS, _gap, _shares, best_model_per_regime, feature_gain, pivot_splits, slice_metrics, slices_of,
    worst_slices_of_best,
)
from sliceworks.session import written


class Evaluation(NamedTuple):
    """What is found out about a suite; a part whose column the predictions lack is null."""

    slices: DataFrame
    summary: DataFrame
    dominance: DataFrame | None
    gaps: DataFrame | None
    worst: DataFrame
    best: DataFrame
    best_slices: DataFrame
    worst_of_best: DataFrame
    gain: DataFrame | None


def reevaluate(
    saved: DataFrame, slice_columns: Sequence[str], *, worst_in: Sequence[str], family: str | None = None,
    variant: tuple[str, str, str] | None = None, gain: dict[str, str] | None = None, split: str = "test",
    top: int = 5, mae_flag: float = 0.02, r2_flag: float = 0.05,
) -> Evaluation:
    """Slices of all splits; error shares by ``family``, the gap of a ``variant`` column (name, base,
    other) and the ``top`` worst slices of every run on one split; the runs compared; the winner of each
    regime with its slices; the worst slices of the overall winner; a ``gain`` as in ``feature_gain``.
    """

    names = list(dict.fromkeys([*slice_columns, *([family] if family else []), *([variant[0]] if variant else [])]))
    found = written(slice_metrics(saved, names, totals=True), "slices")
    totals = ["total_absolute_error", "total_squared_error"]
    slices = found.filter(F.col("slice_name").isin("overall", *slice_columns)).drop(*totals)
    runs = ["ablation_name", "model_name"]
    here = F.col("split_name") == split

    # a whole split of one row has R² 0, a slice of one row has none
    overall = slices.filter("slice_name = 'overall'").withColumn("r2", F.coalesce("r2", F.lit(0.0)))
    summary = pivot_splits(overall, runs, ["mae", "rmse", "r2"])
    of = lambda name: found.filter(here & (F.col("slice_name") == name))
    dominance = gaps = gained = None
    if family in saved.columns:
        shares = of(family).select(
            *RUN_KEYS, F.col("slice_value").alias(family), "sample_count", *totals,
            F.col("mae").alias("mean_absolute_error"))
        dominance = _shares(shares, family, RUN_KEYS)
    if variant and variant[0] in saved.columns:
        gaps = _gap(of(variant[0]).withColumn("r2", F.coalesce("r2", F.lit(0.0))), "slice_value", variant[1],
                    variant[2], RUN_KEYS, mae_flag, r2_flag)
    order = Window.partitionBy(*runs).orderBy(
        F.desc("mae"), F.asc_nulls_first("r2"), "slice_name", "slice_value")
    worst = slices.filter(here & F.col("slice_name").isin(*worst_in)).withColumn(
        "slice_rank", F.row_number().over(order)).filter(F.col("slice_rank") <= top)
    best = best_model_per_regime(summary)
    if gain:
        gained = feature_gain(slices, split=split, **gain)
    return Evaluation(slices, summary, dominance, gaps, worst, best, slices_of(slices, best),
                      worst_slices_of_best(summary, slices, worst_in, split=split, top=top), gained)
