"""Queries on preparation, models, searches, studies and explanations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceworks.models.estimators import (
    Forest, Logistic, MeanRegressor, ModelSpec, Ridge, boosted_classifier, boosted_regressor,
    forest_regressor, suite_classifiers, tuning_classifiers,
)
from sliceworks.models.explain import best_classifier, explain, permutation_importance
from sliceworks.models.prep import (
    classification_prep, regression_prep, release_prep, vector_names,
)
from sliceworks.models.suites import (
    classifier_comparison, comparison, fit_classifiers, fit_per_group, fit_regressors,
    grouped_search, model_importance, regime_study, score, standard_regimes, tune_classifiers,
)
from sliceworks.operators.policy import fixed_split_design, regression_design
from sliceworks.operators.splits import SPLITS, split_rows, split_stratified
from sliceworks.operators.target import agreement_target, target_design
from sliceworks.plans.evaluation import customer_orders, judged_documents
from sliceworks.plans.registry import bits, query, rounded, table
from sliceworks.plans.sql import split_cte
from sliceworks.session import fresh_path
from sliceworks.sources.tables import load_model, read_release_folder, save_model

# Model sizes of the registered queries; the library's defaults are those of the study.
TREES, ROUNDS = 20, 20
FEATURES = ["o_orderpriority", "c_mktsegment", "c_acctbal", "c_nationkey"]

PLANTED = "WITH " + split_cte("customer", "c_custkey") + """
, r AS (SELECT c_custkey, split_name, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey,
    CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer JOIN s USING (c_custkey)),
fit AS (SELECT quantile_cont(acctbal, 0.5) AS median,
    (SELECT segment FROM r WHERE split_name = 'train' AND segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top
  FROM r WHERE split_name = 'train'),
f AS (SELECT c_custkey, split_name, coalesce(segment, top) AS segment, coalesce(acctbal, median) AS acctbal, c_nationkey FROM r, fit),
k AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS sd, avg(c_nationkey) AS nm, stddev_pop(c_nationkey) AS nsd FROM f WHERE split_name = 'train')
"""
SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_FLAGS = ", ".join(
    f"coalesce(segment = '{v}', false)::INT::DOUBLE AS \"segment_{v}\"" for v in SEGMENTS)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with values taken out, split by row."""

    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_acctbal")).alias("acctbal"), "c_nationkey")
    return split_rows(rows, ["c_custkey"])


def vector_columns(model: PipelineModel, df: DataFrame, ids: list[str]) -> DataFrame:
    """The prepared vector as one column per slot."""

    prepared = model.transform(df)
    array = prepared.select(*ids, vector_to_array("features").alias("v"))
    return array.select(*ids, *[F.nanvl(F.col("v")[i], F.lit(None)).alias(name)
                                for i, (name, _) in enumerate(vector_names(prepared))])


def _prepared(spark: SparkSession, sf_dir: str, prep) -> DataFrame:
    rows = planted(spark, sf_dir)
    model = prep(["segment", "acctbal", "c_nationkey"]).fit(rows.filter("split_name = 'train'"))
    return rounded(vector_columns(model, rows, ["c_custkey"]), "acctbal", "c_nationkey")


@query("onehot_passthrough", PLANTED + f"""
SELECT c_custkey, {SEGMENT_FLAGS}, round(acctbal, 6) AS acctbal, c_nationkey::DOUBLE AS c_nationkey FROM r
""")
def onehot_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, classification_prep)


@query("imputed", PLANTED + f"""
SELECT c_custkey, {SEGMENT_FLAGS}, round(acctbal, 6) AS acctbal, c_nationkey::DOUBLE AS c_nationkey FROM f
""")
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, regression_prep)


@query("standardised", PLANTED + f"""
SELECT c_custkey, {SEGMENT_FLAGS}, round((acctbal - m) / sd, 6) AS acctbal, round((c_nationkey - nm) / nsd, 6) AS c_nationkey FROM f, k
""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, release_prep)


# -- regression -------------------------------------------------------------------------------

def ridge(alpha: float = 1.0) -> ModelSpec:
    return ModelSpec("ridge_regression", lambda: Ridge(alpha=alpha, labelCol="amount"))


def dummy() -> ModelSpec:
    return ModelSpec("dummy_mean", lambda: MeanRegressor(labelCol="amount"))


def forest() -> ModelSpec:
    return ModelSpec("random_forest_regressor", lambda: forest_regressor(
        numTrees=TREES, maxDepth=5, labelCol="amount"))


def boosted() -> ModelSpec:
    return ModelSpec("boosted_regressor", lambda: boosted_regressor(
        maxIter=ROUNDS, maxDepth=3, labelCol="amount"))


CLOSED_FORM = "WITH " + split_cte("orders", "o_custkey") + """
, b AS (SELECT o_orderkey, split_name, o_totalprice / 1000 AS y, c_acctbal AS x FROM orders JOIN s USING (o_custkey) JOIN customer ON o_custkey = c_custkey),
k AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM b WHERE split_name = 'train'),
w AS (SELECT sum((x - mx) / sx * (y - my)) / (count(*) + 10.0::DOUBLE) AS slope FROM b, k WHERE split_name = 'train')
"""


@query("ridge_closed_form", CLOSED_FORM + """
SELECT o_orderkey, split_name, round(my + slope * (x - mx) / sx, 6) AS predicted_value FROM b, k, w WHERE split_name <> 'train'
""")
def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on one standardised column, where the closed form is a single quotient."""

    suite = fit_regressors(customer_orders(spark, sf_dir), ["c_acctbal"], "amount", [ridge(10.0)],
                           release_prep, keep=["o_orderkey"])
    return rounded(suite.scored.select("o_orderkey", "split_name", "predicted_value"),
                   "predicted_value")


@query("linear_attribution", CLOSED_FORM + """
, t AS (SELECT o_orderkey, x FROM b WHERE split_name = 'test' ORDER BY md5('43|' || o_orderkey::VARCHAR) LIMIT 1000),
g AS (SELECT avg(x) AS c FROM (SELECT x FROM b WHERE split_name = 'train' ORDER BY md5('42|' || o_orderkey::VARCHAR) LIMIT 500))
SELECT o_orderkey, 'c_acctbal' AS feature, round(slope * (x - c) / sx, 6) AS attribution FROM t, g, k, w
""")
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of the same model on the explained sample against the background sample."""

    rows = customer_orders(spark, sf_dir)
    suite = fit_regressors(rows, ["c_acctbal"], "amount", [ridge(10.0)], release_prep)
    found = explain(suite.models["ridge_regression"], "ridge_regression",
                    rows.filter("split_name = 'train'"), rows.filter("split_name = 'test'"),
                    ["o_orderkey"])
    return rounded(found.values.select("o_orderkey", "feature", "attribution"), "attribution")


@query("dummy_regression", CLOSED_FORM + """
SELECT 'all' AS ablation_name, 'dummy_mean' AS model_name,
  round(avg(abs(y - my)) FILTER (split_name = 'validation'), 6) AS validation_mae,
  round(avg(abs(y - my)) FILTER (split_name = 'test'), 6) AS test_mae FROM b, k
""")
def dummy_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = fit_regressors(customer_orders(spark, sf_dir), FEATURES, "amount", [dummy()], release_prep)
    return rounded(comparison(suite.scored).select(
        "ablation_name", "model_name", "validation_mae", "test_mae"), "validation_mae", "test_mae")


def _regression_scores(spark: SparkSession, sf_dir: str, spec: ModelSpec) -> DataFrame:
    suite = fit_regressors(customer_orders(spark, sf_dir), FEATURES, "amount", [spec],
                           regression_prep if "forest" in spec.name else release_prep)
    return comparison(suite.scored)


@query("ridge_scores")
def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression_scores(spark, sf_dir, ridge())


@query("forest_regression_scores")
def forest_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression_scores(spark, sf_dir, forest())


@query("boosted_regression_scores")
def boosted_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression_scores(spark, sf_dir, boosted())


@query("sealed_benchmark")
def sealed_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on validation only, ordered by MAE; the test rows never reach a model."""

    open_rows = customer_orders(spark, sf_dir).filter("split_name <> 'test'")
    suite = fit_regressors(open_rows, FEATURES, "amount", [dummy(), ridge()], release_prep)
    return comparison(suite.scored).select(
        "model_name", "validation_mae", "validation_rmse", "validation_r2").orderBy("validation_mae")


@query("grouped_search_results")
def grouped_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three penalties by grouped cross-validation."""

    train = customer_orders(spark, sf_dir).filter("split_name = 'train'")
    spec = ModelSpec("ridge_regression", lambda: Ridge(labelCol="amount"),
                     [{"alpha": a} for a in (0.1, 1.0, 10.0)])
    return grouped_search(train, FEATURES, "amount", "o_custkey", [spec])[spec.name].results


@query("regression_suite")
def regression_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, forest and boosted trees on one split, for a column that is given as the target."""

    design = regression_design(
        customer_orders(spark, sf_dir), id_column="o_orderkey", target="amount",
        outcome_columns=["split_name"], excluded=["o_custkey", "o_orderstatus"])
    features = [c for c in design.columns if c not in ("o_orderkey", "amount")]
    split = split_rows(design, ["o_orderkey"])
    return comparison(fit_regressors(split, features, "amount", [dummy(), forest(), boosted()],
                                     regression_prep).scored)


@query("constructed_target_suite")
def constructed_target_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite for the bit-agreement target, joined to its features by id."""

    part = table(spark, sf_dir, "part")
    pairs = part.select("p_partkey", bits("p_partkey", 32).alias("seen"),
                        bits("p_size", 32).alias("ideal"), F.lit(32).alias("width"))
    targets = agreement_target(pairs, id_column="p_partkey", length="width", observed="seen",
                               ideal="ideal")
    design = target_design(part, targets, id_column="p_partkey", target="reliability",
                           allowed=["p_brand", "p_type", "p_size", "p_retailprice"])
    split = split_rows(design, ["p_partkey"])
    specs = [ModelSpec("dummy_regressor", lambda: MeanRegressor(labelCol="reliability")),
             ModelSpec("random_forest_regressor", lambda: forest_regressor(
                 numTrees=TREES, maxDepth=5, labelCol="reliability"))]
    return comparison(fit_regressors(split, ["p_brand", "p_type", "p_size", "p_retailprice"],
                                     "reliability", specs, regression_prep).scored)


@query("release_regression")
def release_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packaged split files, train-only column choice, the suite, its comparison."""

    folder = fresh_path(spark, "release")
    rows = customer_orders(spark, sf_dir).withColumn("fixed", F.lit(1))
    for name in SPLITS:
        rows.filter(F.col("split_name") == name).drop("split_name").write.parquet(
            f"{folder}/{name}.parquet")
    design = fixed_split_design(read_release_folder(spark, folder, payload=["o_orderstatus"]),
                                target="amount", features=[*FEATURES, "fixed"])
    used = [c for c in FEATURES if c in design.columns]
    return comparison(fit_regressors(design, used, "amount", [dummy(), forest()],
                                     regression_prep).scored)


@query("regime_study")
def order_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regimes over two order statuses; the account balance is local to one of them."""

    rows = customer_orders(spark, sf_dir).filter("o_orderstatus IN ('F', 'O')").withColumn(
        "local_balance", F.when(F.col("o_orderstatus") == "O", F.col("c_acctbal")))
    study = regime_study(
        rows, regimes=standard_regimes("F", "O"), models=[dummy(), ridge()], target="amount",
        group="o_custkey", variant="o_orderstatus", shared=["o_orderpriority", "c_nationkey"],
        local=["local_balance"], folds=2)
    return study.summary


@query("permutation_importance")
def order_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_orders(spark, sf_dir)
    suite = fit_regressors(rows, FEATURES, "amount", [ridge()], release_prep)
    return permutation_importance(
        suite.models["ridge_regression"], rows.filter("split_name = 'test'"), FEATURES, "amount",
        ["o_orderkey"], repeats=4)


@query("tree_attribution")
def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_orders(spark, sf_dir)
    suite = fit_regressors(rows, FEATURES, "amount", [forest()], release_prep)
    return explain(suite.models["random_forest_regressor"], "random_forest_regressor",
                   rows.filter("split_name = 'train'"), rows.filter("split_name = 'test'"),
                   ["o_orderkey"]).by_source


@query("tree_attribution_sums", CLOSED_FORM + """
SELECT o_orderkey, 4 AS slots, true AS adds_up FROM b WHERE split_name = 'test' ORDER BY md5('43|' || o_orderkey::VARCHAR) LIMIT 1000
""".replace("4 AS slots", "(2 + (SELECT count(DISTINCT o_orderpriority) FROM orders JOIN s USING (o_custkey) WHERE split_name = 'train') "
            "+ (SELECT count(DISTINCT c_mktsegment) FROM orders JOIN s USING (o_custkey) JOIN customer ON o_custkey = c_custkey "
            "WHERE split_name = 'train'))::INT AS slots"))
def tree_attribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the attributions of each explained row add up to its prediction less the base value."""

    rows = customer_orders(spark, sf_dir)
    spec = ModelSpec("random_forest_regressor", lambda: forest_regressor(numTrees=TREES, labelCol="amount"))
    suite = fit_regressors(rows, FEATURES, "amount", [spec], release_prep)
    test = rows.filter("split_name = 'test'")
    found = explain(suite.models[spec.name], spec.name, rows.filter("split_name = 'train'"), test, ["o_orderkey"])
    sums = found.values.groupBy("o_orderkey").agg(F.sum("attribution").alias("total"),
                                                  F.count(F.lit(1)).cast("int").alias("slots"))
    scored = suite.models[spec.name].transform(test).select("o_orderkey", "prediction")
    gap = F.col("prediction") - F.col("total") - F.lit(found.metadata["base_values"][0])
    return sums.join(scored, "o_orderkey").select("o_orderkey", "slots", (F.abs(gap) < 1e-6).alias("adds_up"))


@query("model_importance")
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_orders(spark, sf_dir)
    suite = fit_regressors(rows, FEATURES, "amount", [forest()], release_prep)
    model = suite.models["random_forest_regressor"]
    return model_importance(model, model.transform(rows))


@query("scored")
def reloaded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved pipeline, loaded again, scores the test rows."""

    rows = customer_orders(spark, sf_dir)
    suite = fit_regressors(rows, FEATURES, "amount", [ridge()], release_prep)
    path = fresh_path(spark, "model")
    save_model(suite.models["ridge_regression"], path)
    return score(load_model(path), rows.filter("split_name = 'test'"), target="amount",
                 name="ridge_regression", keep=["o_orderkey"])


# -- classification ---------------------------------------------------------------------------

QUALITY_FEATURES = ["lang", "n_chars", "toxic"]


def quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged_documents(spark, sf_dir).drop("guess")
    return split_stratified(rows, ["doc_id"], "quality")


def _classifier_scores(spark: SparkSession, sf_dir: str, spec: ModelSpec) -> DataFrame:
    suite = fit_classifiers(quality_split(spark, sf_dir), QUALITY_FEATURES, "quality", [spec])
    return classifier_comparison(suite.scored)


@query("logistic_scores")
def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classifier_scores(spark, sf_dir, ModelSpec(
        "logistic_regression", lambda: Logistic(balanced=True, maxIter=100)))


@query("forest_scores")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classifier_scores(spark, sf_dir, ModelSpec(
        "random_forest", lambda: Forest(numTrees=TREES, balanced=True)))


@query("boosted_scores")
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classifier_scores(spark, sf_dir, ModelSpec(
        "boosted_trees", lambda: boosted_classifier(2, maxIter=ROUNDS, maxDepth=3)))


@query("model_suite")
def model_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = fit_classifiers(quality_split(spark, sf_dir), QUALITY_FEATURES, "quality",
                            suite_classifiers(2, trees=TREES, rounds=5))
    return classifier_comparison(suite.scored)


@query("per_group_suite")
def per_group_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority and the logistic classifier per half of the languages."""

    rows = judged_documents(spark, sf_dir).drop("guess").withColumn(
        "english", (F.col("lang") == "en").cast("int"))
    scored = fit_per_group(rows, "english", ["n_chars", "toxic"], "quality", ["doc_id"],
                           suite_classifiers(2)[:2])
    return classifier_comparison(scored, ["english", "model_name"])


@query("tuned_suite")
def tuned_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest settings chosen on validation, refitted, scored on test."""

    specs = [ModelSpec(s.name, s.build, list(s.grid)[:4]) for s in tuning_classifiers(2, (5, 10))[:1]]
    return tune_classifiers(quality_split(spark, sf_dir), QUALITY_FEATURES, "quality", specs).comparison


@query("explained_classifier")
def explained_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best saved classifier, loaded again and explained on the test split."""

    rows = quality_split(spark, sf_dir)
    suite = fit_classifiers(rows, QUALITY_FEATURES, "quality", [
        ModelSpec("logistic_regression", lambda: Logistic(maxIter=100)),
        ModelSpec("random_forest", lambda: Forest(numTrees=TREES, maxDepth=4))])
    name = best_classifier(suite.models, classifier_comparison(suite.scored))
    path = fresh_path(spark, "classifier")
    save_model(suite.models[name], path)
    return explain(load_model(path), name, rows.filter("split_name = 'train'"),
                   rows.filter("split_name = 'test'"), ["doc_id"]).by_source
