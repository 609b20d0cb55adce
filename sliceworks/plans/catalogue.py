"""The run catalogue: saved runs of every family as one matrix, winners and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceworks.sources.runs import number, scan_json, scan_tables, text

CONFIG_SCHEMA = (
    "dataset_path string, cleaned_dataset_path string, feature_set_name string, "
    "prediction_context string, model_name string"
)
METRIC_SCHEMA = "struct<macro_f1:double,accuracy:double,feature_columns_before_encoding:double>"
SINGLE_MODEL_SCHEMA = (
    f"model_name string, model_display_name string, validation_metrics {METRIC_SCHEMA}, "
    f"test_metrics {METRIC_SCHEMA}, macro_f1 double, accuracy double, "
    "feature_columns_before_encoding double"
)
METRICS = ("validation_macro_f1", "validation_accuracy", "test_macro_f1", "test_accuracy",
           "validation_r2", "test_r2", "validation_mae", "test_mae")


def _configs(spark: SparkSession, root: str) -> DataFrame | None:
    documents = scan_json(spark, root, "run_config.json", CONFIG_SCHEMA)
    if documents is None:
        return None
    return documents.select("run_name", F.col("document").alias("config"))


def _first_in_scope(scope: Sequence[str], order: Sequence[Column]) -> Column:
    window = Window.partitionBy(*scope).orderBy(*order, F.asc("line_number"))
    return F.row_number().over(window) == 1


def _matrix_rows(
    lines: DataFrame | None, configs: DataFrame | None, *, family: str, target_kind: str,
    values: Mapping[str, Column], best_validation: Sequence[tuple[str, bool]],
    best_test: Sequence[tuple[str, bool]], scope: str = "run", tuned: bool = False,
    subset_column: Column | None = None, subset_value: Column | None = None,
) -> DataFrame | None:
    """Matrix rows of one family; only runs with both a result table and a config count."""

    if lines is None or configs is None:
        return None
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = lines.join(configs, "run_name").select(
        F.lit(family).alias("experiment_family"), "run_root", "run_name", "line_number",
        F.concat_ws("/", "run_root", "run_name").alias("run_directory"),
        F.col("config.dataset_path").alias("dataset_path"),
        F.element_at(F.split("config.dataset_path", "/"), -1).alias("dataset_name"),
        F.col("config.cleaned_dataset_path").alias("cleaned_dataset_path"),
        F.col("config.feature_set_name").alias("feature_set_name"),
        F.col("config.prediction_context").alias("prediction_context"),
        F.lit(target_kind).alias("target_kind"), F.lit(scope).alias("selection_scope"),
        (subset_column if subset_column is not None else null_text).alias("subset_column"),
        (subset_value if subset_value is not None else null_text).alias("subset_value"),
        F.lit(tuned).alias("tuning_applied"),
        values.get("model_name", text("model_name")).alias("model_name"),
        values.get("model_display_name", text("model_display_name")).alias("model_display_name"),
        *[values.get(m, null_number).alias(m) for m in METRICS],
        values.get("validation_features", null_number).alias("validation_feature_columns"),
        values.get("test_features", null_number).alias("test_feature_columns"),
        values.get("best_params", null_text).alias("best_params"),
    )
    keys = ["run_name"] + (["subset_value"] if scope == "subgroup" else [])

    def first(order: Sequence[tuple[str, bool]]) -> Column:
        known = F.col(order[0][0]).isNotNull()
        ranks = [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c)
                 for c, descending in order]
        return known & _first_in_scope(keys, ranks)

    return rows.withColumns({
        "is_best_validation_in_scope": first(best_validation),
        "is_best_test_in_scope": first(best_test),
    }).drop("line_number")


BY_VALIDATION_F1 = (("validation_macro_f1", True), ("validation_accuracy", True))
BY_TEST_F1 = (("test_macro_f1", True), ("test_accuracy", True))
BY_VALIDATION_R2 = (("validation_r2", True), ("validation_mae", False))
BY_TEST_R2 = (("test_r2", True), ("test_mae", False))


def scan_classifier_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """Classifier comparisons, with validation columns or in the older layout without them."""

    return _matrix_rows(
        scan_tables(spark, root, "model_comparison.csv"), _configs(spark, root),
        family="classification_global", target_kind="classification",
        values={
            "validation_macro_f1": number("validation_macro_f1"),
            "validation_accuracy": number("validation_accuracy"),
            "test_macro_f1": number("test_macro_f1", "macro_f1"),
            "test_accuracy": number("test_accuracy", "accuracy"),
            "validation_features": number("validation_feature_columns_before_encoding"),
            "test_features": number("test_feature_columns_before_encoding",
                                    "feature_columns_before_encoding"),
        },
        best_validation=BY_VALIDATION_F1, best_test=BY_TEST_F1,
    )


def scan_subgroup_runs(spark: SparkSession, root: str, subgroup: str) -> DataFrame | None:
    """Per-subgroup comparisons; the best flags are per run and subgroup."""

    return _matrix_rows(
        scan_tables(spark, root, "subgroup_model_comparison.csv"), _configs(spark, root),
        family="classification_stratified", target_kind="classification", scope="subgroup",
        subset_column=F.lit(subgroup), subset_value=text(subgroup),
        values={
            **{m: number(m) for m in METRICS[:4]},
            "validation_features": number("validation_feature_columns_before_encoding"),
            "test_features": number("test_feature_columns_before_encoding"),
        },
        best_validation=BY_VALIDATION_F1, best_test=BY_TEST_F1,
    )


def scan_regression_runs(spark: SparkSession, root: str, family: str) -> DataFrame | None:
    """Regression comparisons; best by R², then MAE."""

    return _matrix_rows(
        scan_tables(spark, root, "model_comparison.csv"), _configs(spark, root),
        family=family, target_kind=family,
        values={
            **{m: number(m) for m in METRICS[4:]},
            "validation_features": number("validation_feature_columns_before_encoding"),
            "test_features": number("test_feature_columns_before_encoding"),
        },
        best_validation=BY_VALIDATION_R2, best_test=BY_TEST_R2,
    )


def scan_tuned_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """Tuned comparisons of a filtered subgroup; runs without subset metadata do not count."""

    lines = scan_tables(spark, root, "tuned_model_comparison.csv")
    subsets = scan_json(spark, root, "subset_metadata.json",
                        "filter_column string, filter_value string")
    if lines is None or subsets is None:
        return None
    lines = lines.join(subsets.select("run_name", F.col("document").alias("subset")), "run_name")
    return _matrix_rows(
        lines, _configs(spark, root), family="classification_tuned",
        target_kind="classification", tuned=True, subset_column=F.col("subset.filter_column"),
        subset_value=F.col("subset.filter_value"),
        values={
            "validation_macro_f1": number("best_validation_macro_f1"),
            "test_macro_f1": number("test_macro_f1"), "test_accuracy": number("test_accuracy"),
            "best_params": text("best_params"),
        },
        best_validation=(("validation_macro_f1", True), ("test_accuracy", True)),
        best_test=BY_TEST_F1,
    )


def scan_single_model_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """Single-model metrics documents, nested or in the older flat layout."""

    documents = scan_json(spark, root, "metrics.json", SINGLE_MODEL_SCHEMA)
    configs = _configs(spark, root)
    if documents is None or configs is None:
        return None
    d = "document"
    flat = documents.withColumn("line_number", F.lit(0))
    nested = F.col(f"{d}.test_metrics").isNotNull()
    test = lambda name: F.when(
        nested, F.col(f"{d}.test_metrics.{name}")).otherwise(F.col(f"{d}.{name}"))
    name = F.coalesce(f"{d}.model_name", "config.model_name", F.lit("random_forest"))
    rows = _matrix_rows(
        flat, configs, family="rf_baseline_single_model", target_kind="classification",
        values={
            "model_name": name, "model_display_name": F.coalesce(f"{d}.model_display_name", name),
            "validation_macro_f1": F.col(f"{d}.validation_metrics.macro_f1"),
            "validation_accuracy": F.col(f"{d}.validation_metrics.accuracy"),
            "test_macro_f1": test("macro_f1"), "test_accuracy": test("accuracy"),
            "validation_features": F.col(
                f"{d}.validation_metrics.feature_columns_before_encoding"),
            "test_features": F.coalesce(
                f"{d}.test_metrics.feature_columns_before_encoding",
                f"{d}.feature_columns_before_encoding"),
        },
        best_validation=BY_VALIDATION_F1, best_test=BY_TEST_F1,
    )
    return rows.withColumn("is_best_test_in_scope", F.lit(True))


def experiment_matrix(
    spark: SparkSession, root: str, *, subgroup: str = "qubit_count",
    regression_families: Mapping[str, str] | None = None,
) -> DataFrame | None:
    """All saved runs below a root folder, one row per run, subgroup and model."""

    families = regression_families or {
        "fidelity_regression": "fidelity_regression",
        "reliability_baseline": "reliability_regression",
    }
    parts = [
        scan_single_model_runs(spark, f"{root}/rf_baseline"),
        scan_classifier_runs(spark, f"{root}/model_benchmark"),
        scan_subgroup_runs(spark, f"{root}/qubit_stratified", subgroup),
        *[scan_regression_runs(spark, f"{root}/{folder}", family)
          for folder, family in families.items()],
        scan_tuned_runs(spark, f"{root}/tuned_classification"),
    ]
    return stack_matrix([p for p in parts if p is not None])


def stack_matrix(parts: Sequence[DataFrame]) -> DataFrame | None:
    """Union of run tables on their common columns, in catalogue order."""

    if not parts:
        return None
    matrix = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = ["dataset_name", "experiment_family", "run_name", "subset_value", "model_display_name"]
    return matrix.orderBy(*[F.asc_nulls_last(c) for c in order if c in matrix.columns])


def inventory(matrix: DataFrame) -> DataFrame:
    """Rows, distinct runs and distinct names of a matrix, and runs per family: measure, item,
    value."""

    def distinct(column: str) -> DataFrame:
        names = matrix.filter(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).alias("value"))
        return names.select(F.lit(column).alias("measure"), F.col(column).alias("item"), "value")

    runs = matrix.groupBy("experiment_family", "run_directory").agg(F.count(F.lit(1)).alias("n"))
    per_family = runs.groupBy("experiment_family").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rows"))
    totals = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                      F.countDistinct("run_directory").alias("total_runs"))
    parts = [
        totals.unpivot([], ["total_rows", "total_runs"], "measure", "value").select(
            "measure", F.lit("all").alias("item"), "value"),
        per_family.select(F.lit("run_counts_by_family").alias("measure"),
                          F.col("experiment_family").alias("item"), F.col("runs").alias("value")),
        *[distinct(c) for c in ("dataset_name", "feature_set_name", "prediction_context")],
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def top_row(df: DataFrame, order: Sequence[tuple[str, bool]], scope: str) -> DataFrame:
    """The first row in an order (``True`` = descending), labelled with its scope."""

    ranks = [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c) for c, descending in order]
    return df.orderBy(*ranks).limit(1).select(F.lit(scope).alias("winner_scope"), "*")


def classification_winners(comparison: DataFrame) -> DataFrame:
    """Winner on validation and winner on test of one run."""

    return top_row(comparison, [*BY_VALIDATION_F1, ("model_name", False)], "validation").unionByName(
        top_row(comparison, [*BY_TEST_F1, ("model_name", False)], "test"))


def subgroup_winners(best_by_subgroup: DataFrame, subgroup: str) -> DataFrame:
    """The winner of every subgroup, and the overall winners among these."""

    each = best_by_subgroup.select(
        F.concat(F.lit(f"{subgroup} = "), F.col(subgroup).cast("string")).alias("winner_scope"), "*")
    return each.unionByName(classification_winners(best_by_subgroup))


def regression_reference(comparison: DataFrame) -> DataFrame:
    """The reference regressor of a run. It is selected on *test* R², then validation R²."""

    return top_row(comparison, [("test_r2", True), ("validation_r2", True), ("test_mae", False),
                                ("model_name", False)], "reference")


def best_tuned(comparison: DataFrame) -> DataFrame:
    """Best row of a tuned run."""

    return top_row(comparison, [("best_validation_macro_f1", True), ("test_accuracy", True),
                                ("model_name", False)], "tuned")


def compare_tuning(tuned: DataFrame, untuned: DataFrame, subgroup: str) -> DataFrame:
    """Best tuned row of each subgroup beside the untuned winner: two deltas and a verdict."""

    left = tuned.select(
        F.col(subgroup), F.col("model_name").alias("tuned_model_name"),
        F.col("best_validation_macro_f1").alias("tuned_validation_macro_f1"),
        F.col("test_macro_f1").alias("tuned_test_macro_f1"),
    )
    right = untuned.select(
        F.col(subgroup), F.col("model_name").alias("untuned_model_name"),
        F.col("validation_macro_f1").alias("untuned_validation_macro_f1"),
        F.col("test_macro_f1").alias("untuned_test_macro_f1"),
    )
    joined = left.join(right, subgroup, "left").withColumns({
        "validation_delta":
            F.col("tuned_validation_macro_f1") - F.col("untuned_validation_macro_f1"),
        "test_delta": F.col("tuned_test_macro_f1") - F.col("untuned_test_macro_f1"),
    })
    v, t = F.col("validation_delta"), F.col("test_delta")
    verdict = (
        F.when(v.isNull() | t.isNull(), "no untuned reference")
        .when((v > 0) & (t < 0), "overfitted: validation better, test worse")
        .when((v <= 0) & (t < 0), "no gain: validation not better, test worse")
        .when((v > 0) & (t >= 0), "gain: validation better, test not worse")
        .otherwise("mixed")
    )
    return joined.withColumn("verdict", verdict)


def top_attributions(importance: DataFrame, top: int = 5) -> DataFrame:
    """The features with the largest mean absolute attribution."""

    return importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)


def importance_chart(importance: DataFrame, top: int = 15) -> DataFrame:
    """Data of an importance bar chart."""

    return importance.orderBy(F.desc("importance"), "feature").limit(top)


def slice_chart(slices: DataFrame, slice_name: str, metric: str = "mae", top: int = 10) -> DataFrame:
    """Data of a slice bar chart: the slices with the largest value of a metric."""

    return slices.filter(F.col("slice_name") == slice_name).orderBy(
        F.desc(metric), "slice_value").limit(top)


def scatter_chart(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Data of a scatter plot (actual and predicted, predicted and residual) as counts per cell
    of a grid, which stays small however many points there are."""

    bounds = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    low_x, high_x, low_y, high_y = [float(b) if b is not None else 0.0 for b in bounds]

    def cell(column: str, low: float, high: float) -> Column:
        width = (high - low) / bins or 1.0
        place = F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(width))
        return F.least(place, F.lit(bins - 1)).cast("int")

    return df.groupBy(cell(x, low_x, high_x).alias("x_bin"), cell(y, low_y, high_y).alias("y_bin")
                      ).agg(F.count(F.lit(1)).alias("point_count"))
