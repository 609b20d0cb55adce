"""Queries on predictions, slices, winners and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceworks.models.estimators import DummyClassifier
from sliceworks.models.suites import comparison, fold_results, stacked
from sliceworks.operators.metrics import (
    classification_metrics, classification_report, confusion_matrix, regression_metrics,
    roc_auc_binary, roc_auc_one_vs_rest,
)
from sliceworks.operators.ordering import if_small
from sliceworks.operators.slices import (
    apply_buckets, best_model_per_regime, best_rows, compare_classifiers, compare_regimes,
    compare_regressors, compare_tuned, error_dominance, feature_gain, fit_buckets, predictions,
    slice_metrics, slices_of, variant_gap, worst_slices, worst_slices_of_best,
)
from sliceworks.operators.splits import split_groups, with_folds
from sliceworks.plans.registry import query, rounded, table
from sliceworks.plans.splitting import folds_sql
from sliceworks.plans.sql import (
    MEASURES, PREDICTIONS, SLICE_COLUMNS, SLICES, SUMMARY, split_cte,
)

METRICS = ("mae", "rmse", "r2")
RUN_METRICS = tuple(f"{s}_{m}" for s in ("validation", "test") for m in METRICS)


def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders split by customer, the amount in thousands."""

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        (F.col("o_totalprice") / 1000).alias("amount"))
    return split_groups(orders, "o_custkey")


def with_customers(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Orders with the data of their customer; every order has one."""

    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", "c_acctbal")
    return orders.join(customers, "o_custkey")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split orders with customer data."""

    return with_customers(spark, sf_dir, split_orders(spark, sf_dir))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of two simple models (train mean, train group mean) in two regimes.

    What needs no customer data is fitted before the join, and every held-out row looks all its
    predictions up at once.
    """

    orders = split_orders(spark, sf_dir)
    is_train = F.col("split_name") == "train"
    train = orders.filter(is_train)
    bucketer = fit_buckets(train, "amount")
    rows = with_customers(spark, sf_dir, orders)
    cells = rows.filter(is_train).groupBy("o_orderpriority", "c_mktsegment").agg(
        F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n"))
    # the fitted model: one row per priority and segment
    over = lambda *keys: Window.partitionBy(*(keys or [F.lit(1)]))
    means = cells.select(
        "o_orderpriority", "c_mktsegment", (F.col("s") / F.col("n")).alias("both_mean"),
        (F.sum("s").over(over("o_orderpriority")) / F.sum("n").over(over("o_orderpriority")))
        .alias("priority_mean"),
        (F.sum("s").over(over()) / F.sum("n").over(over())).alias("overall_mean"),
    )
    held = apply_buckets(rows.filter(~is_train), bucketer)
    looked_up = held.join(if_small(means), ["o_orderpriority", "c_mktsegment"])
    guess = lambda regime, model, value: F.struct(
        F.lit(regime).alias("regime"), F.lit(model).alias("model"), value.alias("guess"))
    guesses = F.explode(F.array(
        guess("plain", "dummy_mean", F.col("overall_mean")),
        guess("plain", "group_mean", F.col("priority_mean")),
        guess("with_segment", "dummy_mean", F.col("overall_mean")),
        guess("with_segment", "group_mean", F.col("both_mean")),
    ))
    long = looked_up.withColumn("g", guesses).withColumn("guess", F.col("g.guess"))
    return predictions(long, truth="amount", predicted="guess", ablation=F.col("g.regime"),
                       model=F.col("g.model")).drop(
        "g", "guess", "priority_mean", "both_mean", "overall_mean")


def order_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_metrics(scored_orders(spark, sf_dir), SLICE_COLUMNS)


ROUNDED_SLICE = ("split_name, ablation_name, model_name, slice_name, slice_value, sample_count, "
                 "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2")


@query("difficulty_buckets", PREDICTIONS + """
SELECT split_name, difficulty_bucket, count(*) AS row_count, min(amount) AS low, max(amount) AS high
FROM held GROUP BY ALL
""")
def difficulty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_orders(spark, sf_dir)
    bucketer = fit_buckets(rows.filter("split_name = 'train'"), "amount")
    return apply_buckets(rows.filter("split_name <> 'train'"), bucketer).groupBy(
        "split_name", "difficulty_bucket").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("amount").alias("low"),
        F.max("amount").alias("high"))


@query("predictions", PREDICTIONS + """
SELECT o_orderkey, split_name, ablation_name, model_name, target_value,
  round(predicted_value, 6) AS predicted_value, round(residual, 6) AS residual,
  round(absolute_error, 6) AS absolute_error, round(squared_error, 4) AS squared_error FROM pred
""")
def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_orders(spark, sf_dir).select(
        "o_orderkey", "split_name", "ablation_name", "model_name", "target_value",
        "predicted_value", "residual", "absolute_error", "squared_error")
    return rounded(rounded(rows, "predicted_value", "residual", "absolute_error"),
                   "squared_error", digits=4)


@query("slice_metrics", SLICES + f"SELECT {ROUNDED_SLICE} FROM sliced")
def order_slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(order_slices(spark, sf_dir), *METRICS)


@query("null_slices", PREDICTIONS + f"""
, p AS (SELECT *, nullif(o_orderstatus, 'F') AS status FROM pred)
SELECT {ROUNDED_SLICE} FROM (
  SELECT split_name, ablation_name, model_name, 'overall' AS slice_name, 'overall' AS slice_value, {MEASURES} FROM p GROUP BY ALL
  UNION ALL SELECT split_name, ablation_name, model_name, 'status', coalesce(status, 'nan'), {MEASURES} FROM p GROUP BY ALL)
""")
def null_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_orders(spark, sf_dir).withColumn("status", F.expr("nullif(o_orderstatus, 'F')"))
    return rounded(slice_metrics(rows, ["status", "absent_column"]), *METRICS)


@query("regression_metrics", SUMMARY + """
SELECT ablation_name, model_name, round(validation_mae, 6) AS validation_mae,
  round(validation_rmse, 6) AS validation_rmse, round(validation_r2, 6) AS validation_r2,
  round(test_mae, 6) AS test_mae, round(test_rmse, 6) AS test_rmse, round(test_r2, 6) AS test_r2 FROM summary
""")
def order_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparison(scored_orders(spark, sf_dir)), *RUN_METRICS)


@query("small_slice_metrics", PREDICTIONS + """
, p AS (SELECT o_orderkey, absolute_error, squared_error FROM pred WHERE ablation_name = 'plain' AND model_name = 'dummy_mean')
SELECT o_orderkey, 1 AS sample_count, round(absolute_error, 6) AS mae, round(sqrt(squared_error), 6) AS rmse,
  NULL::DOUBLE AS slice_r2, 0.0::DOUBLE AS split_r2 FROM p
""")
def small_slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one row: R² is null for a slice and 0 for a whole split."""

    rows = scored_orders(spark, sf_dir).filter("ablation_name = 'plain' AND model_name = 'dummy_mean'")
    as_slice = regression_metrics(rows, ["o_orderkey"], small_r2=None).withColumnRenamed("r2", "slice_r2")
    as_split = regression_metrics(rows, ["o_orderkey"], small_r2=0.0).select(
        "o_orderkey", F.col("r2").alias("split_r2"))
    return rounded(as_slice.join(as_split, "o_orderkey"), "mae", "rmse")


@query("error_dominance", PREDICTIONS + """
, f AS (SELECT split_name, ablation_name, model_name, c_mktsegment, count(*) AS sample_count,
    sum(absolute_error) AS a, sum(squared_error) AS q FROM pred GROUP BY ALL)
SELECT split_name, ablation_name, model_name, c_mktsegment, sample_count, round(a, 3) AS total_absolute_error,
  round(q, 1) AS total_squared_error, round(a / sample_count, 6) AS mean_absolute_error,
  round(sample_count / sum(sample_count) OVER w, 6) AS sample_fraction,
  round(a / sum(a) OVER w, 6) AS absolute_error_fraction, round(q / sum(q) OVER w, 6) AS squared_error_fraction
FROM f WINDOW w AS (PARTITION BY split_name, ablation_name, model_name)
""")
def order_error_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = error_dominance(scored_orders(spark, sf_dir), "c_mktsegment")
    shares = rounded(shares, "mean_absolute_error", "sample_fraction", "absolute_error_fraction",
                     "squared_error_fraction")
    return rounded(rounded(shares, "total_absolute_error", digits=3), "total_squared_error", digits=1)


@query("variant_gap", "WITH " + split_cte("lineitem", "l_orderkey") + f"""
, rows AS (SELECT lineitem.*, split_name FROM lineitem JOIN s USING (l_orderkey)),
rate AS (SELECT sum(l_extendedprice) / sum(l_quantity) AS r FROM rows WHERE split_name = 'train'),
p AS (SELECT split_name, l_returnflag, l_extendedprice / 1000 AS target_value,
    abs(l_quantity * r / 1000 - l_extendedprice / 1000) AS absolute_error,
    (l_quantity * r / 1000 - l_extendedprice / 1000) ** 2 AS squared_error FROM rows, rate WHERE split_name <> 'train'),
m AS (SELECT split_name, l_returnflag, {MEASURES} FROM p GROUP BY ALL),
g AS (SELECT split_name, max(CASE WHEN l_returnflag = 'A' THEN mae END) - max(CASE WHEN l_returnflag = 'R' THEN mae END) AS dm,
    max(CASE WHEN l_returnflag = 'A' THEN r2 END) - max(CASE WHEN l_returnflag = 'R' THEN r2 END) AS dr FROM m GROUP BY split_name)
SELECT split_name, 'all' AS ablation_name, 'rate' AS model_name, true AS available, round(dm, 6) AS delta_mae,
  round(dr, 6) AS delta_r2, abs(dm) >= 0.02 OR abs(dr) >= 0.05 AS sharp_difference_flag, 3 AS variants FROM g
""")
def lineitem_variant_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_groups(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice"), "l_orderkey")
    rate = rows.filter("split_name = 'train'").agg(
        F.sum("l_extendedprice") / F.sum("l_quantity")).first()[0]
    scored = predictions(
        rows.filter("split_name <> 'train'").withColumns({
            "price": F.col("l_extendedprice") / 1000, "guess": F.col("l_quantity") * rate / 1000}),
        truth="price", predicted="guess", model="rate")
    gap = variant_gap(scored, "l_returnflag", "R", "A").withColumn(
        "variants", F.size("variant_metrics")).drop("variant_metrics")
    return rounded(gap, "delta_mae", "delta_r2")


@query("worst_slices", SLICES + f"""
SELECT {ROUNDED_SLICE} FROM sliced WHERE split_name = 'test' AND slice_name IN ('c_mktsegment', 'o_orderpriority')
ORDER BY round(mae, 9) DESC, r2 ASC NULLS FIRST, ablation_name LIMIT 5
""")
def order_worst_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # equal slices of the two regimes are told apart by the regime, the last sort key
    slices = order_slices(spark, sf_dir).filter("split_name = 'test'")
    keyed = slices.withColumns({
        "mae": F.round("mae", 9), "slice_value": F.concat("slice_value", F.lit("|"), "ablation_name")})
    worst = worst_slices(keyed, ["c_mktsegment", "o_orderpriority"])
    return rounded(worst.withColumn("slice_value", F.substring_index("slice_value", "|", 1)), *METRICS)


SUMMARY_COLUMNS = "ablation_name, model_name, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in RUN_METRICS)
BEST = SUMMARY + """
, best AS (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY ablation_name
    ORDER BY validation_r2 DESC, validation_mae, model_name) = 1)
"""


@query("best_per_scope", BEST + f"SELECT {SUMMARY_COLUMNS} FROM best")
def best_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(best_model_per_regime(comparison(scored_orders(spark, sf_dir))), *RUN_METRICS)


@query("best_slices", BEST + f"""
SELECT {ROUNDED_SLICE} FROM sliced SEMI JOIN best USING (ablation_name, model_name)
""")
def best_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_orders(spark, sf_dir)
    slices = slice_metrics(scored, SLICE_COLUMNS)
    return rounded(slices_of(slices, best_model_per_regime(comparison(scored))), *METRICS)


@query("worst_slices_of_best", BEST + f"""
, winner AS (SELECT * FROM summary ORDER BY validation_r2 DESC, validation_mae, ablation_name LIMIT 1)
SELECT {ROUNDED_SLICE} FROM sliced SEMI JOIN winner USING (ablation_name, model_name)
WHERE split_name = 'test' AND slice_name IN ('c_mktsegment', 'o_orderpriority')
ORDER BY mae DESC, r2 ASC NULLS FIRST, slice_name, slice_value LIMIT 5
""")
def order_worst_slices_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_orders(spark, sf_dir)
    worst = worst_slices_of_best(comparison(scored), slice_metrics(scored, SLICE_COLUMNS),
                                 ["c_mktsegment", "o_orderpriority"])
    return rounded(worst, *METRICS)


@query("feature_gain", SLICES + """
, f AS (SELECT * FROM sliced WHERE split_name = 'test' AND slice_name = 'c_mktsegment' AND slice_value = 'BUILDING'
  QUALIFY row_number() OVER (PARTITION BY ablation_name ORDER BY r2 DESC, mae, model_name) = 1),
d AS (SELECT max(CASE WHEN ablation_name = 'with_segment' THEN mae END) - max(CASE WHEN ablation_name = 'plain' THEN mae END) AS dm,
  max(CASE WHEN ablation_name = 'with_segment' THEN r2 END) - max(CASE WHEN ablation_name = 'plain' THEN r2 END) AS dr,
  max(CASE WHEN ablation_name = 'plain' THEN sample_count END) AS a, max(CASE WHEN ablation_name = 'with_segment' THEN sample_count END) AS b FROM f)
SELECT true AS available, 'BUILDING' AS slice_value, round(dm, 6) AS delta_mae, round(dr, 6) AS delta_r2,
  dm <= -0.01 OR dr >= 0.03 AS material_improvement_flag, a AS without_sample_count, b AS with_sample_count FROM d
""")
def order_feature_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = feature_gain(order_slices(spark, sf_dir), slice_name="c_mktsegment",
                        slice_value="BUILDING", without="plain", with_extra="with_segment")
    return rounded(gain, "delta_mae", "delta_r2")


@query("stacked_comparison", SUMMARY + f"""
SELECT 'regimes' AS report, {SUMMARY_COLUMNS} FROM summary
UNION ALL SELECT 'regressors', {SUMMARY_COLUMNS} FROM summary WHERE ablation_name = 'plain'
""")
def stacked_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = comparison(scored_orders(spark, sf_dir))
    tables = {"regimes": compare_regimes(summary),
              "regressors": compare_regressors(summary.filter("ablation_name = 'plain'"))}
    return rounded(stacked(t.withColumn("report", F.lit(name)) for name, t in tables.items()),
                   *RUN_METRICS)


@query("fold_results", folds_sql("orders", "o_custkey", 3).replace("WITH", "WITH folds AS (WITH", 1) + """),
b AS (SELECT o.*, c_mktsegment, fold, o_totalprice / 1000 AS amount FROM orders o JOIN folds USING (o_custkey) JOIN customer ON o_custkey = c_custkey),
n AS (SELECT range AS f FROM range(3)),
m0 AS (SELECT f, avg(amount) AS m FROM b JOIN n ON fold <> f GROUP BY f),
m1 AS (SELECT f, c_mktsegment, avg(amount) AS m FROM b JOIN n ON fold <> f GROUP BY f, c_mktsegment),
p AS (SELECT 'global mean' AS setting, fold, amount, m FROM b JOIN m0 ON fold = f
  UNION ALL SELECT 'segment mean', fold, amount, m FROM b JOIN m1 ON fold = f AND b.c_mktsegment = m1.c_mktsegment),
k AS (SELECT setting, fold, avg(abs(m - amount)) AS mae, sqrt(avg((m - amount) ** 2)) AS rmse,
    1 - sum((m - amount) ** 2) / (var_pop(amount) * count(*)) AS r2 FROM p GROUP BY ALL)
SELECT setting, FOLDS round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2, round(avg(mae), 6) AS mean_mae,
  round(stddev_pop(mae), 6) AS std_mae, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse,
  rank() OVER (ORDER BY avg(r2) DESC) AS rank_r2, rank() OVER (ORDER BY avg(mae)) AS rank_mae,
  rank() OVER (ORDER BY avg(rmse)) AS rank_rmse FROM k GROUP BY setting
""".replace("FOLDS", ", ".join(f"round(max({m}) FILTER (fold = {k}), 6) AS fold{k}_{m}"
                               for m in ("r2", "mae", "rmse") for k in range(3)) + ","))
def order_fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of a global and a segment mean, all folds in one pass.

    The mean of the other folds is the total minus the fold's own part.
    """

    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", (F.col("o_totalprice") / 1000).alias("amount"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = with_folds(orders, "o_custkey", 3).join(customers, "o_custkey")
    sums = rows.groupBy("fold", "c_mktsegment").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    all_sums = sums.groupBy("c_mktsegment").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    segment = sums.join(all_sums, "c_mktsegment").select(
        "fold", "c_mktsegment",
        ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("segment mean"))
    per_fold = sums.groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = per_fold.agg(F.sum("s"), F.sum("n")).first()
    everyone = per_fold.select("fold", ((F.lit(total[0]) - F.col("s")) / (F.lit(total[1]) - F.col("n")))
                               .alias("global mean"))
    means = if_small(segment.join(everyone, "fold"))  # one row per fold and segment
    guessed = rows.join(means, ["fold", "c_mktsegment"]).unpivot(
        ["fold", "amount"], ["global mean", "segment mean"], "setting", "guess")
    results = fold_results(guessed, "amount", "guess")
    return rounded(results, *[c for c in results.columns if c != "setting" and not c.startswith("rank")])


# -- classification ---------------------------------------------------------------------------

def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality, and a guess of it from the length."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    guess = (F.col("n_chars") >= 300).cast("int")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").withColumn("guess", guess)


JUDGED = """
WITH j AS (SELECT quality::VARCHAR AS y, (n_chars >= 300)::INT::VARCHAR AS p, lang, n_chars
  FROM labels JOIN documents USING (doc_id))
"""


@query("confusion", JUDGED + """
, l AS (SELECT * FROM (VALUES (0, '0'), (1, '1'), (2, 'unseen')) t(i, label))
SELECT a.i AS row_index, b.i AS column_index, a.label AS truth, b.label AS predicted, count(j.y) AS cell_count
FROM l a CROSS JOIN l b LEFT JOIN j ON j.y = a.label AND j.p = b.label GROUP BY ALL
""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_matrix(judged_documents(spark, sf_dir), "quality", "guess", ["0", "1", "unseen"])


def _class_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return JUDGED + f"""
, sides AS (SELECT {k}y AS label, 1 AS s, 0 AS g, (y = p)::INT AS h FROM j
  UNION ALL SELECT {k}p, 0, 1, 0 FROM j),
lab AS (SELECT {k}label, sum(s) AS support, sum(g) AS guessed, sum(h) AS hits FROM sides GROUP BY ALL),
rep AS (SELECT {k}label, support, hits, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
  CASE WHEN guessed + support = 0 THEN 0 ELSE 2 * hits / (guessed + support) END AS f1 FROM lab)
"""


@query("class_metrics", _class_sql("lang") + """
SELECT lang, sum(support)::BIGINT AS sample_count, round(sum(hits) / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep GROUP BY lang
""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = classification_metrics(judged_documents(spark, sf_dir), "quality", "guess", ["lang"])
    return rounded(metrics, "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query("class_report", _class_sql("") + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM rep
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
  round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM rep
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM rep
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM rep
""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classification_report(judged_documents(spark, sf_dir), "quality", "guess"),
                   "precision", "recall", "f1")


@query("majority_class", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT doc_id, quality::VARCHAR AS truth, (SELECT quality::VARCHAR FROM c ORDER BY n DESC, quality LIMIT 1) AS guess
FROM labels
""")
def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("label", F.col("quality").cast("double"))
    guessed = DummyClassifier().fit(labels).transform(labels)
    return guessed.select("doc_id", F.col("quality").cast("string").alias("truth"),
                          F.col("prediction").cast("int").cast("string").alias("guess"))


@query("roc_auc", JUDGED + """
, pairs AS (SELECT sum(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END) AS w, count(*) AS n
  FROM j a, j b WHERE a.y = '1' AND b.y = '0')
SELECT round(w::DOUBLE / n, 6) AS roc_auc FROM pairs
""")
def quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(-F.col("n_chars"), F.col("n_chars")).cast("array<double>")
    rows = judged_documents(spark, sf_dir).withColumn("scores", scores)
    return rounded(roc_auc_binary(rows, "quality", "scores", ["0", "1"]), "roc_auc")


@query("auc_one_vs_rest", """
WITH e AS (SELECT label, range AS k, round(embedding[range + 1]::DOUBLE, 2) AS score FROM embeddings, range(10)),
r AS (SELECT k, label, avg(rn) OVER (PARTITION BY k, score) AS mid FROM
  (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score) AS rn FROM e)),
a AS (SELECT k, count(*) FILTER (label = k) AS p, count(*) FILTER (label <> k) AS n,
  sum(mid) FILTER (label = k) AS s FROM r GROUP BY k)
SELECT round(avg((s - p * (p + 1) / 2.0) / (p * n)), 6) AS roc_auc_ovr_macro FROM a
""")
def auc_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x.cast("double"), 2))
    rows = table(spark, sf_dir, "embeddings").select("label", scores.alias("scores"))
    return rounded(roc_auc_one_vs_rest(rows, "label", "scores", [str(i) for i in range(10)]),
                   "roc_auc_ovr_macro")


@query("classifier_order", _class_sql("lang") + """
, m AS (SELECT lang AS model_name, round(avg(f1), 6) AS validation_macro_f1, round(sum(hits) / sum(support), 6) AS validation_accuracy FROM rep GROUP BY lang)
SELECT 'suite' AS report, model_name, validation_macro_f1, validation_accuracy FROM m
UNION ALL SELECT 'tuned', model_name, validation_macro_f1, validation_accuracy FROM m
UNION ALL SELECT 'best', * FROM (SELECT * FROM m ORDER BY validation_macro_f1 DESC, validation_accuracy DESC, model_name LIMIT 1)
""")
def classifier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for models: comparison tables and the best of the scope."""

    metrics = classification_metrics(judged_documents(spark, sf_dir), "quality", "guess", ["lang"])
    results = rounded(metrics.select(
        F.col("lang").alias("model_name"), F.col("macro_f1").alias("validation_macro_f1"),
        F.col("accuracy").alias("validation_accuracy")), "validation_macro_f1", "validation_accuracy")
    tuned = compare_tuned(results.withColumns({
        "best_validation_macro_f1": F.col("validation_macro_f1"),
        "test_accuracy": F.col("validation_accuracy")}))
    best = best_rows(results.withColumn("scope", F.lit(1)), ["scope"], [
        F.desc("validation_macro_f1"), F.desc("validation_accuracy"), F.asc("model_name")])
    tables = {"suite": compare_classifiers(results), "tuned": tuned, "best": best}
    return stacked(t.select(F.lit(name).alias("report"), "model_name", "validation_macro_f1",
                            "validation_accuracy") for name, t in tables.items())


