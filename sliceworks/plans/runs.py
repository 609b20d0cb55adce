"""Queries on sources, sinks and the run catalogue. What they write goes to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.models.suites import comparison
from sliceworks.operators.metrics import classification_metrics
from sliceworks.operators.reevaluation import Evaluation, reevaluate
from sliceworks.operators.rules import split_valid
from sliceworks.operators.slices import best_classifier_per_scope, pivot_splits, slice_metrics
from sliceworks.operators.splits import SPLITS, split_groups, split_rows
from sliceworks.plans.catalogue import (
    best_tuned, classification_winners, compare_tuning, experiment_matrix, importance_chart,
    inventory, regression_reference, scatter_chart, slice_chart, subgroup_winners,
    top_attributions,
)
from sliceworks.plans.cleaning import LINEITEM_CHECKED, LINEITEM_RULES, SEQUENCE, _part_log
from sliceworks.plans.evaluation import (
    METRICS, ROUNDED_SLICE, RUN_METRICS, SUMMARY_COLUMNS, judged_documents, order_slices, scored_orders,
)
from sliceworks.plans.registry import ORACLES, query, rounded, table
from sliceworks.plans.sql import (
    GROUPED_ORDERS, MEASURES, PREDICTIONS, SLICE_COLUMNS, SLICES, SUMMARY, split_cte,
)
from sliceworks.session import fresh_path, written
from sliceworks.sources.runs import scan_tables, text, write_result_table, write_run_config
from sliceworks.sources.tables import (
    RAW_LOG_SCHEMA, read_predictions, read_raw_log, read_release_folder, read_table, write_feature_tables, write_predictions,
    write_prepared,
)

ORDERS_TEXT = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
"""


@query("csv_round_trip", ORDERS_TEXT)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders") + ".csv"
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders.write.csv(path, header=True)
    # the schema names the types; the file's header decides the order
    types = {f.name: f for f in orders.schema}
    schema = T.StructType([types[c] for c in reversed(orders.columns)])
    return read_table(spark, path, schema=schema, required=orders.columns)


@query("raw_log", """
SELECT p_partkey::VARCHAR AS circuit_id, p_size::VARCHAR AS qubit_count, replace(p_type, ' ', ', ') AS gate_types,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE round(p_retailprice, 2)::VARCHAR END AS error_rate_gate,
  'say "' || p_brand || '"' || chr(10) || p_type AS device_type, NULL::VARCHAR AS error_type FROM part
""")
def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw log with quoted commas, quotes and line breaks, its columns in another order, every field text."""

    text = lambda c: F.col(c).cast("string")
    known = {
        "circuit_id": text("p_partkey"), "qubit_count": text("p_size"),
        "gate_types": F.replace("p_type", F.lit(" "), F.lit(", ")),
        "error_rate_gate": F.when(F.col("p_size") % 3 != 0, F.round("p_retailprice", 2).cast("string")),
        "device_type": F.concat(F.lit('say "'), "p_brand", F.lit('"\n'), "p_type")}
    names = [f.name for f in reversed(RAW_LOG_SCHEMA.fields)]
    path = fresh_path(spark, "raw-log") + ".csv"
    table(spark, sf_dir, "part").select(*[known.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.csv(
        path, header=True, escape='"')
    return read_raw_log(spark, path).select(*known, "error_type")


@query("quoted_text_round_trip", """
SELECT doc_id, source, n_chars, length(text) AS n_read, md5(text) AS digest FROM documents
""")
def quoted_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, quotes and line breaks included, written as CSV and read from split files."""

    path = fresh_path(spark, "documents") + ".csv"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    documents.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False)
    back = read_table(spark, path, string_columns=["text", "source"], required=documents.columns)
    return back.select(F.col("doc_id").cast("long"), "source", F.col("n_chars").cast("long"),
                       F.length("text").alias("n_read"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("parquet_round_trip", ORDERS_TEXT)
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders") + ".parquet"
    table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.parquet(path)
    return read_table(spark, path)


@query("prepared_files", LINEITEM_CHECKED + """
SELECT 'cleaned' AS part, count(*) AS row_count, sum(l_partkey)::BIGINT AS part_keys FROM checked WHERE len(issues) = 0
UNION ALL SELECT 'invalid', count(*), sum(l_partkey)::BIGINT FROM checked WHERE len(issues) > 0
UNION ALL SELECT 'report', count(*), NULL FROM checked
""")
def prepared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned Parquet, quarantine CSV and report JSON written and read back."""

    folder = fresh_path(spark, "prepared")
    prepared = split_valid(table(spark, sf_dir, "lineitem"), LINEITEM_RULES)
    write_prepared(prepared, cleaned_path=f"{folder}/cleaned", invalid_path=f"{folder}/invalid.csv",
                   report_path=f"{folder}/report", source_columns=["l_discount"])
    part = lambda name, df: df.select(
        F.lit(name).alias("part"), F.col("l_partkey").cast("long").alias("k")).groupBy("part").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("k").alias("part_keys"))
    report = spark.read.json(f"{folder}/report/summary").filter("measure = 'rows_read'").select(
        F.lit("report").alias("part"), F.col("value").alias("row_count"),
        F.lit(None).cast("long").alias("part_keys"))
    return part("cleaned", read_table(spark, f"{folder}/cleaned", file_format="parquet")).unionByName(
        part("invalid", read_table(spark, f"{folder}/invalid.csv"))).unionByName(report)


@query("feature_files", """
SELECT * FROM (VALUES ('baseline_raw', 4), ('topology_aware', 11), ('enhanced_topology', 18)) t(name, width),
  (SELECT count(*) AS row_count FROM part)
""")
def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = write_feature_tables(
        _part_log(spark, sf_dir), fresh_path(spark, "features"), id_column="p_partkey",
        label_column="p_type", base_columns=["gate_error", "depth"], sequence=SEQUENCE,
        gate_error="gate_error", readout_error="readout", fidelity="fidelity")
    counts = [t.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"), F.lit(len(t.columns)).alias("width"), "row_count")
        for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("release_union", GROUPED_ORDERS + """
SELECT split_name, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders JOIN s USING (o_custkey)
""")
def release_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "release")
    split = split_groups(table(spark, sf_dir, "orders").drop("o_orderdate"), "o_custkey")
    for name in SPLITS:
        split.filter(F.col("split_name") == name).drop("split_name").write.parquet(
            f"{folder}/{name}.parquet")
    return read_release_folder(spark, folder, payload=["o_orderstatus"])


@query("saved_predictions", SLICES + f"SELECT {ROUNDED_SLICE} FROM sliced WHERE split_name = 'test'")
def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned prediction files; the test filter prunes the other folders."""

    folder = fresh_path(spark, "predictions")
    write_predictions(scored_orders(spark, sf_dir), folder)
    saved = read_predictions(spark, folder).filter("split_name = 'test'")
    return rounded(slice_metrics(saved, SLICE_COLUMNS), *METRICS)


def saved_evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    """Everything about the order models from their prediction files."""

    folder = fresh_path(spark, "predictions")
    write_predictions(scored_orders(spark, sf_dir), folder)
    return reevaluate(
        read_predictions(spark, folder), SLICE_COLUMNS, worst_in=["c_mktsegment", "o_orderpriority"],
        family="c_mktsegment", variant=("o_orderstatus", "F", "O"),
        gain={"slice_name": "c_mktsegment", "slice_value": "BUILDING", "without": "plain", "with_extra": "with_segment"})


@query("saved_summary", f"{SUMMARY}SELECT {SUMMARY_COLUMNS} FROM summary")
def saved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved_evaluation(spark, sf_dir).summary, *RUN_METRICS)


@query("saved_dominance", ORACLES["error_dominance"].replace("FROM pred GROUP BY ALL", "FROM pred WHERE split_name = 'test' GROUP BY ALL"))
def saved_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = rounded(saved_evaluation(spark, sf_dir).dominance, "mean_absolute_error", "sample_fraction",
                     "absolute_error_fraction", "squared_error_fraction")
    return rounded(rounded(shares, "total_absolute_error", digits=3), "total_squared_error", digits=1)


@query("saved_variant_gap", PREDICTIONS + f"""
, m AS (SELECT ablation_name, model_name, o_orderstatus, {MEASURES} FROM pred WHERE split_name = 'test' GROUP BY ALL),
g AS (SELECT ablation_name, model_name, max(CASE WHEN o_orderstatus = 'O' THEN mae END) - max(CASE WHEN o_orderstatus = 'F' THEN mae END) AS dm,
    max(CASE WHEN o_orderstatus = 'O' THEN r2 END) - max(CASE WHEN o_orderstatus = 'F' THEN r2 END) AS dr, count(*) AS variants FROM m GROUP BY ALL)
SELECT 'test' AS split_name, ablation_name, model_name, true AS available, round(dm, 6) AS delta_mae, round(dr, 6) AS delta_r2,
  abs(dm) >= 0.02 OR abs(dr) >= 0.05 AS sharp_difference_flag, variants FROM g
""")
def saved_variant_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = saved_evaluation(spark, sf_dir).gaps
    return rounded(gaps.withColumn("variants", F.size("variant_metrics")).drop("variant_metrics"),
                   "delta_mae", "delta_r2")


@query("saved_worst_slices", SLICES + f"""
SELECT {ROUNDED_SLICE}, rn AS slice_rank FROM (SELECT *, row_number() OVER (PARTITION BY ablation_name, model_name
    ORDER BY mae DESC, r2 ASC NULLS FIRST, slice_name, slice_value) AS rn FROM sliced
  WHERE split_name = 'test' AND slice_name IN ('c_mktsegment', 'o_orderpriority')) WHERE rn <= 5
""")
def saved_worst_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved_evaluation(spark, sf_dir).worst, *METRICS)


@query("saved_best_slices", ORACLES["best_slices"])
def saved_best_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved_evaluation(spark, sf_dir).best_slices, *METRICS)


@query("saved_worst_of_best", ORACLES["worst_slices_of_best"])
def saved_worst_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved_evaluation(spark, sf_dir).worst_of_best, *METRICS)


@query("saved_feature_gain", ORACLES["feature_gain"])
def saved_feature_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(saved_evaluation(spark, sf_dir).gain, "delta_mae", "delta_r2")


# -- run folders ------------------------------------------------------------------------------

RULES = {"long_300": 300, "long_1000": 1000}
CLASS_METRICS = ("accuracy", "macro_f1")

# Two length rules as models of quality, scored on the held-out splits, overall and per language.
RULE_METRICS = "WITH " + split_cte("labels", "doc_id") + """
, j AS (SELECT lang, split_name, quality::VARCHAR AS y, n_chars FROM labels JOIN documents USING (doc_id) JOIN s USING (doc_id)
  WHERE split_name <> 'train'),
g AS (SELECT j.*, 'long_300' AS model_name, (n_chars >= 300)::INT::VARCHAR AS p FROM j
  UNION ALL SELECT j.*, 'long_1000', (n_chars >= 1000)::INT::VARCHAR FROM j),
sides AS (SELECT lang, split_name, model_name, y AS label, 1 AS s, 0 AS g, (y = p)::INT AS h FROM g
  UNION ALL SELECT lang, split_name, model_name, p, 0, 1, 0 FROM g),
scopes AS (SELECT 'all' AS scope, split_name, model_name, label, s, g, h FROM sides
  UNION ALL SELECT lang, split_name, model_name, label, s, g, h FROM sides),
lab AS (SELECT scope, split_name, model_name, label, sum(s) AS s, sum(g) AS g, sum(h) AS h FROM scopes GROUP BY ALL),
k AS (SELECT scope, split_name, model_name, round(sum(h) / sum(s), 6) AS accuracy,
  round(avg(CASE WHEN g + s = 0 THEN 0 ELSE 2 * h / (g + s) END), 6) AS macro_f1 FROM lab GROUP BY ALL),
c AS (SELECT scope, model_name, max(CASE WHEN split_name = 'validation' THEN accuracy END) AS validation_accuracy,
  max(CASE WHEN split_name = 'validation' THEN macro_f1 END) AS validation_macro_f1,
  max(CASE WHEN split_name = 'test' THEN accuracy END) AS test_accuracy,
  max(CASE WHEN split_name = 'test' THEN macro_f1 END) AS test_macro_f1 FROM k GROUP BY ALL)
"""


def rule_comparison(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Validation and test metrics of the two rules, overall or per value of a column."""

    split = split_rows(judged_documents(spark, sf_dir).drop("guess"), ["doc_id"])
    guesses = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model_name"), (F.col("n_chars") >= n).cast("int").alias("guess"))
        for name, n in RULES.items()]))
    rows = split.filter("split_name <> 'train'").withColumn("g", guesses).select("*", "g.*")
    keys = [*([by] if by else []), "model_name"]
    metrics = classification_metrics(rows, "quality", "guess", ["split_name", *keys])
    compared = pivot_splits(metrics, keys, CLASS_METRICS)
    return rounded(compared, *[c for c in compared.columns if c not in keys])


def write_runs(spark: SparkSession, sf_dir: str) -> str:
    """Run folders of every family, in the layouts the catalogue reads."""

    root = fresh_path(spark, "experiments")
    named = lambda df: df.withColumn("model_display_name", F.initcap("model_name"))
    # result tables of a few rows each; written once, they serve every layout below
    overall = written(named(rule_comparison(spark, sf_dir)), "overall").orderBy("model_name")
    per_lang = written(named(rule_comparison(spark, sf_dir, "lang")), "per-lang").orderBy(
        "lang", "model_name")
    amounts = written(named(rounded(comparison(scored_orders(spark, sf_dir)).filter(
        "ablation_name = 'plain'"), *RUN_METRICS)), "amounts").orderBy("model_name")

    def run(family: str, name: str, context: str = "pre_execution") -> str:
        folder = f"{root}/{family}/{name}"
        write_run_config(spark, folder, {
            "dataset_path": f"data/{family}.parquet", "feature_set_name": "baseline",
            "prediction_context": context})
        return folder

    write_result_table(overall, run("model_benchmark", "run_new"))
    # the older layout: test columns without a prefix, no validation
    write_result_table(overall.select(
        "model_name", "model_display_name", F.col("test_accuracy").alias("accuracy"),
        F.col("test_macro_f1").alias("macro_f1")), run("model_benchmark", "run_old", "legacy"))
    write_result_table(per_lang, run("qubit_stratified", "run_lang"), "subgroup_model_comparison.csv")
    write_result_table(amounts.drop("ablation_name"), run("fidelity_regression", "run_amount"))
    tuned = run("tuned_classification", "run_tuned")
    write_result_table(overall.select(
        "model_name", "model_display_name",
        F.col("validation_macro_f1").alias("best_validation_macro_f1"), "test_accuracy",
        "test_macro_f1", F.lit("{'maxDepth': 8, 'numTrees': 200}").alias("best_params")),
        tuned, "tuned_model_comparison.csv")
    spark.createDataFrame([("lang", "en")], "filter_column string, filter_value string").coalesce(
        1).write.json(f"{tuned}/subset_metadata.json")
    single = run("rf_baseline", "run_single")
    test = F.struct(F.col("test_macro_f1").alias("macro_f1"), F.col("test_accuracy").alias("accuracy"))
    overall.filter("model_name = 'long_300'").select(
        "model_name", "model_display_name", test.alias("test_metrics")).coalesce(1).write.json(
        f"{single}/metrics.json")
    return root


@query("run_scan", RULE_METRICS + """
SELECT 'run_new' AS run_name, model_name, validation_macro_f1::VARCHAR AS validation_macro_f1,
  coalesce(test_macro_f1, NULL)::VARCHAR AS test_macro_f1 FROM c WHERE scope = 'all'
UNION ALL SELECT 'run_old', model_name, NULL, test_macro_f1::VARCHAR FROM c WHERE scope = 'all'
""")
def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan_tables(spark, f"{write_runs(spark, sf_dir)}/model_benchmark", "model_comparison.csv")
    return lines.select(
        "run_name", text("model_name").alias("model_name"),
        text("validation_macro_f1").alias("validation_macro_f1"),
        F.coalesce(text("test_macro_f1"), text("macro_f1")).alias("test_macro_f1"))


MATRIX_COLUMNS = ("experiment_family", "run_name", "dataset_name", "prediction_context",
                  "subset_value", "model_name", "validation_macro_f1", "test_macro_f1",
                  "test_accuracy", "validation_r2", "test_r2", "is_best_validation_in_scope",
                  "is_best_test_in_scope")

# The matrix in SQL: the rule metrics and the order regressors in their run families.
MATRIX_SQL = (
    RULE_METRICS
    + ", reg AS (SELECT * FROM (" + SUMMARY + "\nSELECT model_name, round(validation_r2, 6) AS vr, "
    "round(validation_mae, 6) AS vm, round(test_r2, 6) AS tr, round(test_mae, 6) AS tm FROM summary "
    "WHERE ablation_name = 'plain')),"
    + """
m AS (
  SELECT 'classification_global' AS experiment_family, 'run_new' AS run_name, 'model_benchmark.parquet' AS dataset_name,
    'pre_execution' AS prediction_context, NULL AS subset_value, model_name, validation_macro_f1, validation_accuracy,
    test_macro_f1, test_accuracy, NULL::DOUBLE AS validation_r2, NULL::DOUBLE AS test_r2 FROM c WHERE scope = 'all'
  UNION ALL SELECT 'classification_global', 'run_old', 'model_benchmark.parquet', 'legacy', NULL, model_name, NULL, NULL,
    test_macro_f1, test_accuracy, NULL, NULL FROM c WHERE scope = 'all'
  UNION ALL SELECT 'classification_stratified', 'run_lang', 'qubit_stratified.parquet', 'pre_execution', scope, model_name,
    validation_macro_f1, validation_accuracy, test_macro_f1, test_accuracy, NULL, NULL FROM c WHERE scope <> 'all'
  UNION ALL SELECT 'classification_tuned', 'run_tuned', 'tuned_classification.parquet', 'pre_execution', 'en', model_name,
    validation_macro_f1, test_accuracy, test_macro_f1, test_accuracy, NULL, NULL FROM c WHERE scope = 'all'),
f AS (
  SELECT *, validation_macro_f1 IS NOT NULL AND row_number() OVER (PARTITION BY run_name, subset_value
      ORDER BY validation_macro_f1 DESC NULLS LAST, validation_accuracy DESC NULLS LAST, model_name) = 1 AS is_best_validation_in_scope,
    test_macro_f1 IS NOT NULL AND row_number() OVER (PARTITION BY run_name, subset_value
      ORDER BY test_macro_f1 DESC NULLS LAST, test_accuracy DESC NULLS LAST, model_name) = 1 AS is_best_test_in_scope FROM m
  UNION ALL SELECT 'fidelity_regression', 'run_amount', 'fidelity_regression.parquet', 'pre_execution', NULL, model_name,
    NULL, NULL, NULL, NULL, vr, tr, row_number() OVER (ORDER BY vr DESC, vm, model_name) = 1,
    row_number() OVER (ORDER BY tr DESC, tm, model_name) = 1 FROM reg
  UNION ALL SELECT 'rf_baseline_single_model', 'run_single', 'rf_baseline.parquet', 'pre_execution', NULL, model_name,
    NULL, NULL, test_macro_f1, test_accuracy, NULL, NULL, false, true FROM c WHERE scope = 'all' AND model_name = 'long_300')
"""
)


@query("comparison_matrix", MATRIX_SQL + f"SELECT {', '.join(MATRIX_COLUMNS)} FROM f")
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment_matrix(spark, write_runs(spark, sf_dir), subgroup="lang").select(*MATRIX_COLUMNS)


@query("inventory", MATRIX_SQL + """
SELECT 'total_rows' AS measure, 'all' AS item, count(*) AS value FROM f
UNION ALL SELECT 'total_runs', 'all', count(DISTINCT run_name) FROM f
UNION ALL SELECT 'run_counts_by_family', experiment_family, count(DISTINCT run_name) FROM f GROUP BY experiment_family
UNION ALL SELECT 'dataset_name', dataset_name, count(*) FROM f GROUP BY dataset_name
UNION ALL SELECT 'feature_set_name', 'baseline', count(*) FROM f
UNION ALL SELECT 'prediction_context', prediction_context, count(*) FROM f GROUP BY prediction_context
""")
def run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(experiment_matrix(spark, write_runs(spark, sf_dir), subgroup="lang"))


WINNER = "model_name, validation_macro_f1, test_macro_f1"


@query("run_winners", RULE_METRICS + ", reg AS (SELECT * FROM (" + SUMMARY + """
SELECT * FROM summary WHERE ablation_name = 'plain')),
best AS (SELECT * FROM c WHERE scope <> 'all' QUALIFY row_number() OVER (PARTITION BY scope
  ORDER BY validation_macro_f1 DESC NULLS LAST, validation_accuracy DESC NULLS LAST, model_name) = 1)
""" + f"""
SELECT 'run' AS source, 'validation' AS winner_scope, {WINNER} FROM (SELECT * FROM c WHERE scope = 'all' ORDER BY validation_macro_f1 DESC NULLS LAST, validation_accuracy DESC NULLS LAST, model_name LIMIT 1)
UNION ALL SELECT 'run', 'test', {WINNER} FROM (SELECT * FROM c WHERE scope = 'all' ORDER BY test_macro_f1 DESC NULLS LAST, test_accuracy DESC NULLS LAST, model_name LIMIT 1)
UNION ALL SELECT 'tuned', 'tuned', {WINNER} FROM (SELECT * FROM c WHERE scope = 'all' ORDER BY validation_macro_f1 DESC NULLS LAST, test_accuracy DESC NULLS LAST, model_name LIMIT 1)
UNION ALL SELECT 'subgroups', 'lang = ' || scope, {WINNER} FROM best
UNION ALL SELECT 'regression', 'reference', model_name, NULL, NULL FROM (SELECT * FROM reg ORDER BY test_r2 DESC, validation_r2 DESC, test_mae LIMIT 1)
""")
def run_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = rule_comparison(spark, sf_dir)
    best = best_classifier_per_scope(rule_comparison(spark, sf_dir, "lang"), ["lang"])
    regressors = comparison(scored_orders(spark, sf_dir)).filter("ablation_name = 'plain'")
    columns = ["winner_scope", "model_name", "validation_macro_f1", "test_macro_f1"]
    empty = F.lit(None).cast("double")
    tables = {
        "run": classification_winners(overall),
        "tuned": best_tuned(overall.withColumn("best_validation_macro_f1", F.col("validation_macro_f1"))),
        # the overall winners among subgroups repeat one of the rows
        "subgroups": subgroup_winners(best, "lang").filter(F.col("winner_scope").startswith("lang")),
        "regression": regression_reference(regressors).withColumns({
            "validation_macro_f1": empty, "test_macro_f1": empty}),
    }
    return reduce(lambda a, b: a.unionByName(b),
                  [t.select(F.lit(name).alias("source"), *columns) for name, t in tables.items()])


@query("tuning_comparison", RULE_METRICS + """
, best AS (SELECT * FROM c WHERE scope <> 'all' QUALIFY row_number() OVER (PARTITION BY scope
  ORDER BY validation_macro_f1 DESC NULLS LAST, validation_accuracy DESC NULLS LAST, model_name) = 1),
t AS (SELECT * FROM c WHERE scope <> 'all' AND model_name = 'long_1000'),
d AS (SELECT t.scope AS lang, t.model_name AS tuned_model_name, u.model_name AS untuned_model_name,
  t.validation_macro_f1 - u.validation_macro_f1 AS v, t.test_macro_f1 - u.test_macro_f1 AS w
  FROM t LEFT JOIN (SELECT * FROM best WHERE scope <> 'de') u ON t.scope = u.scope)
SELECT lang, tuned_model_name, untuned_model_name, round(v, 6) AS validation_delta, round(w, 6) AS test_delta,
  CASE WHEN v IS NULL OR w IS NULL THEN 'no untuned reference'
    WHEN v > 0 AND w < 0 THEN 'overfitted: validation better, test worse'
    WHEN v <= 0 AND w < 0 THEN 'no gain: validation not better, test worse'
    WHEN v > 0 AND w >= 0 THEN 'gain: validation better, test not worse' ELSE 'mixed' END AS verdict FROM d
""")
def tuning_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_lang = rule_comparison(spark, sf_dir, "lang")
    untuned = best_classifier_per_scope(per_lang, ["lang"]).filter("lang <> 'de'")
    tuned = per_lang.filter("model_name = 'long_1000'").withColumn(
        "best_validation_macro_f1", F.col("validation_macro_f1"))
    return rounded(compare_tuning(tuned, untuned, "lang").select(
        "lang", "tuned_model_name", "untuned_model_name", "validation_delta", "test_delta",
        "verdict"), "validation_delta", "test_delta")


@query("top_attributions", """
WITH a AS (
  SELECT 'l_tax' AS feature, avg(abs(l_tax)) AS v FROM lineitem UNION ALL SELECT 'l_discount', avg(abs(l_discount)) FROM lineitem
  UNION ALL SELECT 'l_quantity', avg(l_quantity) FROM lineitem UNION ALL SELECT 'l_linenumber', avg(l_linenumber) FROM lineitem
  UNION ALL SELECT 'l_suppkey', avg(l_suppkey) FROM lineitem UNION ALL SELECT 'l_partkey', avg(l_partkey) FROM lineitem)
SELECT feature, round(v, 4) AS mean_abs_shap FROM a ORDER BY v DESC LIMIT 5
""")
def attribution_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking step alone, on column means in place of attributions."""

    names = ["l_tax", "l_discount", "l_quantity", "l_linenumber", "l_suppkey", "l_partkey"]
    means = table(spark, sf_dir, "lineitem").agg(
        *[F.avg(F.abs(F.col(c).cast("double"))).alias(c) for c in names])
    return rounded(top_attributions(means.unpivot([], names, "feature", "mean_abs_shap")),
                   "mean_abs_shap", digits=4)


@query("chart_data", PREDICTIONS + """
, p AS (SELECT * FROM pred WHERE ablation_name = 'plain' AND model_name = 'group_mean'),
b AS (SELECT min(target_value) AS lx, max(target_value) AS hx, min(residual) AS ly, max(residual) AS hy FROM p)
SELECT least(floor((target_value - lx) / ((hx - lx) / 10)), 9)::INT AS x_bin,
  least(floor((residual - ly) / ((hy - ly) / 10)), 9)::INT AS y_bin, count(*) AS point_count FROM p, b GROUP BY ALL
""")
def residual_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_orders(spark, sf_dir).filter("ablation_name = 'plain' AND model_name = 'group_mean'")
    return scatter_chart(rows, "target_value", "residual", bins=10)


@query("chart_bars", SLICES + """
, one AS (SELECT * FROM sliced WHERE split_name = 'test' AND ablation_name = 'plain' AND model_name = 'group_mean')
SELECT * FROM (SELECT 'slices' AS chart, slice_value AS item, round(mae, 6) AS bar FROM one
  WHERE slice_name = 'o_orderpriority' ORDER BY mae DESC LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'importance', slice_value, round(rmse, 6) FROM one
  WHERE slice_name = 'c_mktsegment' ORDER BY rmse DESC LIMIT 2)
""")
def bar_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = order_slices(spark, sf_dir).filter(
        "split_name = 'test' AND ablation_name = 'plain' AND model_name = 'group_mean'")
    slices = slice_chart(one, "o_orderpriority", top=3).select(
        F.lit("slices").alias("chart"), F.col("slice_value").alias("item"), F.col("mae").alias("bar"))
    ranking = one.filter("slice_name = 'c_mktsegment'").select(
        F.col("slice_value").alias("feature"), F.col("rmse").alias("importance"))
    bars = importance_chart(ranking, 2).select(
        F.lit("importance").alias("chart"), F.col("feature").alias("item"),
        F.col("importance").alias("bar"))
    return rounded(slices.unionByName(bars), "bar")
