"""Classification and regression metrics, whole or per group of rows, each in one grouped pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceworks.functions.numbers import safe_ratio
from sliceworks.operators.ordering import with_running_totals


def regression_measures(
    truth: str | Column = "target_value", predicted: str | Column = "predicted_value",
    small_r2: float | None = None,
) -> dict[str, Column]:
    """Aggregates for n, MAE, RMSE and R².

    R² is ``1 - SSE / SST``. Without spread in the truth it is 1 for a perfect fit, else 0.
    Below two rows it is ``small_r2`` (0 for whole splits, null for slices).
    """

    y = (F.col(truth) if isinstance(truth, str) else truth).cast("double")
    p = (F.col(predicted) if isinstance(predicted, str) else predicted).cast("double")
    n, sse = F.count(F.lit(1)), F.sum((p - y) * (p - y))
    sst = F.var_pop(y) * n
    r2 = (
        F.when(n < 2, F.lit(small_r2).cast("double"))
        .when(sst > 0, 1.0 - sse / sst)
        .when(sse == 0, 1.0)
        .otherwise(0.0)
    )
    return {"sample_count": n, "mae": F.avg(F.abs(p - y)), "rmse": F.sqrt(sse / n), "r2": r2}


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), *, truth: str = "target_value",
    predicted: str = "predicted_value", small_r2: float | None = 0.0,
) -> DataFrame:
    """One row of metrics per group of rows."""

    measures = regression_measures(truth, predicted, small_r2)
    return df.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def confusion_counts(
    df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Non-zero cells of the confusion matrix, labels as text. All label metrics start here."""

    return df.groupBy(
        *by, F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string")
        .alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("cell_count"))


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str]
) -> DataFrame:
    """Every cell for the given labels in their order, zeros included."""

    order = [str(label) for label in labels]
    grid = df.sparkSession.createDataFrame(
        [(i, a, j, b) for i, a in enumerate(order) for j, b in enumerate(order)],
        "row_index int, truth string, column_index int, predicted string")
    cells = confusion_counts(df, truth, predicted)
    return grid.join(cells, ["truth", "predicted"], "left").select(
        "row_index", "column_index", "truth", "predicted",
        F.coalesce("cell_count", F.lit(0)).alias("cell_count"),
    )


def label_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label, from confusion counts; 0 on empty division.

    The labels are those of truth and prediction together.
    """

    hit = F.when(F.col("truth") == F.col("predicted"), F.col("cell_count")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("cell_count").alias("support"),
                 F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("cell_count").alias("guessed"), F.lit(0).cast("long").alias("hits")),
    )
    totals = (
        cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "label").agg(F.sum("support").alias("support"),
                                   F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    )
    return totals.select(
        *by, "label", safe_ratio(F.col("hits"), F.col("guessed")).alias("precision"),
        safe_ratio(F.col("hits"), F.col("support")).alias("recall"),
        safe_ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"),
        "support", "hits",
    )


def _averages(report: DataFrame, by: Sequence[str]) -> DataFrame:
    support = F.sum("support")
    weighted = lambda c: safe_ratio(F.sum(F.col(c) * F.col("support")), support)
    return report.groupBy(*by).agg(
        support.alias("sample_count"),
        safe_ratio(F.sum("hits"), support).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
    )


def classification_metrics(
    df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, macro precision, recall and F1, weighted F1 per group of rows."""

    report = label_report(confusion_counts(df, truth, predicted, by), by)
    return _averages(report, by).drop("weighted_precision", "weighted_recall")


def classification_report(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """The per-label report with its accuracy, macro and weighted rows."""

    report = label_report(confusion_counts(df, truth, predicted))
    if labels is not None:
        report = report.filter(F.col("label").isin(*[str(x) for x in labels]))
    total = _averages(report, [])
    extra = F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"),
                 F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), F.col("macro_precision").alias("precision"),
                 F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1")),
        F.struct(F.lit("weighted avg").alias("label"),
                 F.col("weighted_precision").alias("precision"),
                 F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1")),
    )
    rows = total.select(F.explode(extra).alias("e"), F.col("sample_count").alias("support"))
    return report.drop("hits").unionByName(rows.select("e.*", "support"))


def roc_auc(df: DataFrame, is_positive: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group of rows; null when a class is absent.

    Rows are first collapsed to distinct scores. The running count of negatives below each score
    is assembled from score buckets, so a single task never orders the whole table.
    """

    by = list(by)
    positive = F.col(is_positive).cast("int")
    per_score = (
        df.groupBy(*by, F.col(score).cast("double").alias("_score"))
        .agg(F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
    )
    running = with_running_totals(per_score, "_score", {"_neg": "_below"}, by)
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return running.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def roc_auc_binary(df: DataFrame, truth: str, scores: str, labels: Sequence[str]) -> DataFrame:
    """Two classes: the last label in order is positive and owns the second score."""

    positive = str(labels[-1])
    rows = df.select((F.col(truth).cast("string") == positive).alias("_is"),
                     F.element_at(scores, 2).alias("_s"))
    return roc_auc(rows, "_is", "_s")


def roc_auc_one_vs_rest(
    df: DataFrame, truth: str, scores: str, labels: Sequence[str]
) -> DataFrame:
    """More classes: the plain mean of each class against the rest. ``scores`` is an array in
    label order."""

    names = F.array(*[F.lit(str(x)) for x in labels])
    long = df.select(F.col(truth).cast("string").alias("_truth"), F.posexplode(scores))
    per_class = long.select(
        F.element_at(names, F.col("pos") + 1).alias("label"), "_truth",
        F.col("col").cast("double").alias("_s"),
    ).withColumn("_is", F.col("_truth") == F.col("label"))
    return roc_auc(per_class, "_is", "_s", ["label"]).agg(
        F.avg("roc_auc").alias("roc_auc_ovr_macro"))
