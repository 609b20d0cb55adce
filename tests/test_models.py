"""Preparation, learners, search, explanations, saved models and the run catalogue."""

from __future__ import annotations

import itertools
import json
import math
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sliceworks.models.estimators import (
    DummyClassifier, Logistic, ModelSpec, Ridge, boosted_classifier, forest_regressor,
)
from sliceworks.models.explain import (
    base_values, explain, flat_tree, permutation_importance, tree_attributions,
)
from sliceworks.models.prep import classification_prep, regression_prep, release_prep, vector_names
from sliceworks.models.suites import (
    Regime, comparison, fit_classifiers, fit_regressors, fold_results, grouped_search, model_importance,
    regime_study,
)
from sliceworks.plans.catalogue import (
    compare_tuning, experiment_matrix, inventory, scan_single_model_runs,
)
from sliceworks.session import fresh_path
from sliceworks.sources.tables import infer_format, load_model, read_table, save_model


def local_rows(spark, validation_value=100.0):
    rows = [("train", "raw", 1.0, 3.0), ("train", "transpiled", None, 3.0), ("train", "raw", 3.0, 2.0),
            ("train", "raw", 5.0, 4.0), ("validation", "other", validation_value, None)]
    return spark.createDataFrame(rows, "split_name string, variant string, x double, z double")


def matrix(model, df):
    return [tuple(r[0]) for r in model.transform(df).select(vector_to_array("features")).collect()]


def test_preparation_sees_train_only(spark):
    df = local_rows(spark)
    train = df.filter("split_name = 'train'")
    model = regression_prep(["variant", "x", "z"]).fit(train)
    got = matrix(model, df)
    assert got[1] == (0.0, 1.0, 3.0, 3.0)  # the median of 1, 3, 5
    assert got[4] == (0.0, 0.0, 100.0, 3.0)  # an unseen category is all zeros
    assert [n for n, _ in vector_names(model.transform(df))] == [
        "variant_raw", "variant_transpiled", "x", "z"]
    other = release_prep(["variant", "x", "z"]).fit(
        local_rows(spark, 5.0).filter("split_name = 'train'"))
    same = release_prep(["variant", "x", "z"]).fit(train)
    assert matrix(other, train) == matrix(same, train)


def test_standardised_columns(spark):
    df = spark.createDataFrame([(1.0, 7.0, True), (3.0, 7.0, False), (None, 7.0, True)],
                               "x double, c double, b boolean")
    model = release_prep(["x", "c", "b"]).fit(df)
    got = np.array(matrix(model, df))
    assert got.shape == (3, 4)  # booleans are categories
    assert got[:, 2].mean() == pytest.approx(0) and got[:, 2].std() == pytest.approx(1)
    assert list(got[:, 3]) == [0, 0, 0]


def test_all_null_column_is_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, gone double")
    assert matrix(regression_prep(["x", "gone"]).fit(df), df) == [(1.0,), (2.0,)]


def test_passthrough_keeps_unknown_as_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    model = classification_prep(["c", "x"]).fit(train)
    assert matrix(model, spark.createDataFrame([("z", 3.0), (None, 4.0)], "c string, x double")) == [
        (0, 0, 3.0), (0, 0, 4.0)]


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=60)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)],
                               ["features", "label"])
    model = Ridge(alpha=10.0).fit(df)
    centered = x - x.mean(0)
    expected = np.linalg.solve(centered.T @ centered + 10 * np.eye(3), centered.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(expected, abs=1e-9)


def test_logistic_penalty(spark):
    """At the optimum the gradient of penalty and summed loss vanishes."""

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)],
                               ["features", "label"])
    model = Logistic(c=0.5, maxIter=500).fit(df)
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert w + 0.5 * x.T @ (p - y) == pytest.approx(np.zeros(2), abs=1e-3)


def test_dummy_strategies(spark):
    df = spark.range(400).select("id", F.lit(Vectors.dense(0.0).values.tolist()).alias("f"),
                                 (F.col("id") % 4 == 0).cast("double").alias("label"))
    assert DummyClassifier().fit(df).transform(df).select("prediction").distinct().first()[0] == 0.0
    prior = DummyClassifier(strategy="prior").fit(df).transform(df).first()
    assert prior["scores"] == [0.75, 0.25]
    drawn = DummyClassifier(strategy="stratified", idCol="id").fit(df).transform(df)
    assert 0.1 < drawn.agg(F.avg("prediction")).first()[0] < 0.4
    again = DummyClassifier(strategy="stratified", idCol="id").fit(df).transform(df.repartition(5))
    assert sorted(drawn.select("id", "prediction").collect()) == sorted(
        again.select("id", "prediction").collect())
    with pytest.raises(ValueError, match="idCol"):
        DummyClassifier(strategy="uniform").fit(df)


def regression_rows(spark):
    df = spark.range(240).select(
        "id", (F.col("id") % 40).alias("g"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
        F.when(F.col("id") % 40 < 30, "train").when(F.col("id") % 40 < 35, "validation")
        .otherwise("test").alias("split_name"))
    return df.withColumn("y", F.col("x") * 2 + F.when(F.col("c") == "a", 3.0).otherwise(0.0))


def forest():
    return ModelSpec("random_forest_regressor",
                     lambda: forest_regressor(numTrees=5, maxDepth=4, labelCol="y"))


def test_search_and_explanations(spark):
    df = regression_rows(spark)
    train, test = df.filter("split_name = 'train'"), df.filter("split_name = 'test'")
    spec = ModelSpec("ridge_regression", lambda: Ridge(labelCol="y"),
                     [{"alpha": 100.0}, {"alpha": 0.1}])
    found = grouped_search(train, ["x", "c"], "y", "g", [spec], folds=3)["ridge_regression"]
    assert found.best == {"alpha": 0.1} and found.best_r2 > 0.99
    assert found.results.orderBy("rank_r2").first()["setting"] == "{'alpha': 0.1}"
    with pytest.raises(ValueError, match="two groups"):
        grouped_search(train.filter("g = 1"), ["x"], "y", "g", [spec])

    linear = explain(found.model, "ridge_regression", train, test, ["id"])
    sums = linear.values.groupBy("id").agg(F.sum("attribution").alias("s"))
    base = found.model.transform(test).join(sums, "id").agg(
        F.stddev_pop(F.col("prediction") - F.col("s"))).first()[0]
    assert base < 1e-9
    assert {r["feature"] for r in linear.by_source.collect()} == {"x", "c"}

    suite = fit_regressors(df, ["x", "c"], "y", [forest()], release_prep, keep=["id"])
    model = suite.models["random_forest_regressor"]
    trees = explain(model, "random_forest_regressor", train, test, ["id"], max_rows=20)
    sums = trees.values.groupBy("id").agg(F.sum("attribution").alias("s"))
    base = model.transform(test).join(sums, "id").agg(
        F.stddev_pop(F.col("prediction") - F.col("s")), F.count("*")).first()
    assert base[0] < 1e-9 and base[1] == 20
    assert comparison(suite.scored).first()["test_r2"] > 0.8
    assert model_importance(model, model.transform(df)).first()["feature"] == "x"
    rise = permutation_importance(model, test, ["x", "c"], "y", ["id"], max_rows=30, repeats=3)
    assert rise.first()["feature"] == "x" and rise.count() == 2
    with pytest.raises(ValueError, match="no attribution"):
        explain(model, "dummy_mean", train, test, ["id"])

    path = fresh_path(spark, "model")
    save_model(model, path)
    assert load_model(path).transform(test).select("prediction").collect() == \
        model.transform(test).select("prediction").collect()


def random_tree(dice, features: int, depth: int, classes: int) -> dict[int, dict]:
    """A node table such as Spark saves: thresholds, categories, features asked again."""

    nodes, waiting = {}, [(0, 0, 64.0)]
    while waiting:
        number, level, count = waiting.pop()
        node = nodes[number] = {"rawCount": count, "leftChild": -1, "rightChild": -1,
                                "prediction": dice.normal(), "impurityStats": dice.randint(1, 9, classes)}
        if level < depth and count > 2 and dice.rand() < 0.85:
            low = float(dice.randint(1, int(count)))
            left = len(nodes) + len(waiting)
            while left in nodes or any(left in (w[0], w[0] + 1) for w in waiting):
                left += 1
            node |= {"leftChild": left, "rightChild": left + 1}
            feature = int(dice.randint(features))
            node["split"] = {"featureIndex": feature, "numCategories": 3 if feature == 0 else -1,
                             "leftCategoriesOrThreshold": [float(dice.randint(3))] if feature == 0
                             else [dice.normal()]}
            waiting += [(left, level + 1, low), (left + 1, level + 1, count - low)]
    return nodes


@pytest.mark.parametrize("seed", range(12))
def test_tree_attributions_against_all_coalitions(seed):
    dice = np.random.RandomState(seed)
    features, by_class = 4, seed % 2 == 0
    tables = [random_tree(dice, features, 1 + seed % 6, 2) for _ in range(3)]
    x = dice.normal(size=(5, features))
    x[:, 0] = dice.randint(0, 4, 5)  # a code that no split knows too

    def expected(nodes, number, row, known, k):
        node = nodes[number]
        if node["leftChild"] < 0:
            stats = node["impurityStats"]
            return stats[k] / stats.sum() if by_class else node["prediction"]
        split, children = node["split"], (node["leftChild"], node["rightChild"])
        feature, asked = split["featureIndex"], split["leftCategoriesOrThreshold"]
        below = [expected(nodes, c, row, known, k) for c in children]
        if feature not in known:
            return sum(v * nodes[c]["rawCount"] for v, c in zip(below, children, strict=True)) / node["rawCount"]
        if split["numCategories"] > 0 and row[feature] > 2:
            return 0.0  # an unknown code meets neither side
        left = row[feature] in asked if split["numCategories"] > 0 else row[feature] <= asked[0]
        return below[0] if left else below[1]

    value = lambda row, known, k: sum(expected(n, 0, row, known, k) for n in tables) / 3
    plain = np.zeros((2 if by_class else 1, *x.shape))
    for k, i, j in itertools.product(range(len(plain)), range(len(x)), range(features)):
        others = [f for f in range(features) if f != j]
        for size in range(features):
            for known in itertools.combinations(others, size):
                share = math.factorial(size) * math.factorial(features - 1 - size) / math.factorial(features)
                plain[k, i, j] += share * (value(x[i], {*known, j}, k) - value(x[i], set(known), k))
    trees = [flat_tree(n, 1 / 3, by_class) for n in tables]
    assert tree_attributions(x, trees) == pytest.approx(plain, abs=1e-9)
    assert base_values(trees) == pytest.approx([value(x[0], set(), k) for k in range(len(plain))])


def test_large_ensembles_take_time_by_nodes():
    """Full trees of depth 12, as the study's forests have, in a moment each."""

    dice = np.random.RandomState(1)
    nodes = {}
    for number in range(2 ** 13 - 1):
        inner = number < 2 ** 12 - 1
        nodes[number] = {"rawCount": 2.0 ** (12 - int(math.log2(number + 1))), "prediction": dice.normal(),
                         "leftChild": 2 * number + 1 if inner else -1, "rightChild": 2 * number + 2 if inner else -1,
                         "split": {"featureIndex": int(dice.randint(30)), "numCategories": -1,
                                   "leftCategoriesOrThreshold": [dice.normal()]}}
    tree, x = flat_tree(nodes, 1.0, False), dice.normal(size=(50, 30))
    start = time.perf_counter()
    found = tree_attributions(x, [tree])[0]
    assert time.perf_counter() - start < 5

    def predict(row, number=0):
        while nodes[number]["leftChild"] >= 0:
            split = nodes[number]["split"]
            left = row[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0]
            number = nodes[number]["leftChild" if left else "rightChild"]
        return nodes[number]["prediction"]

    assert found.sum(1) + base_values([tree])[0] == pytest.approx([predict(row) for row in x])


def test_classifiers_with_three_labels(spark):
    df = regression_rows(spark).withColumn(
        "label", F.when(F.col("x") < 2, "low").when(F.col("x") < 5, "mid").otherwise("top"))
    suite = fit_classifiers(df, ["x", "c"], "label", [
        ModelSpec("boosted_trees", lambda: boosted_classifier(3, maxIter=2, maxDepth=2)),
        ModelSpec("dummy_most_frequent", lambda: DummyClassifier())])
    assert suite.labels == ["low", "mid", "top"]
    rows = suite.scored.filter("model_name = 'boosted_trees'")
    assert rows.filter("true_label = predicted_label").count() == rows.count()
    assert {len(r["scores"]) for r in rows.collect()} == {3}


def test_tables_and_formats(spark, tmp_path):
    assert infer_format("a/b.CSV") == "csv" and infer_format("x.parquet") == "parquet"
    with pytest.raises(ValueError, match="Cannot infer"):
        infer_format("x.txt")
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))
    path = tmp_path / "t.csv"
    path.write_text("id,x\n007,1\nNA,2\n")
    table = read_table(spark, str(path), string_columns=["id"], required=["id", "x"])
    assert [tuple(r) for r in table.collect()] == [("007", 1), (None, 2)]
    with pytest.raises(ValueError, match="Missing required columns: y"):
        read_table(spark, str(path), required=["y"])


def write_run(folder, name, files):
    run = folder / name
    run.mkdir(parents=True)
    config = {"dataset_path": "data/log.csv", "feature_set_name": "raw", "prediction_context": "pre"}
    for file, content in {"run_config.json": json.dumps(config), **files}.items():
        (run / file).write_text(content)


def test_catalogue_of_every_family(spark, tmp_path):
    head = "model_name,model_display_name,"
    write_run(tmp_path / "model_benchmark", "new", {"model_comparison.csv":
              head + "validation_macro_f1,validation_accuracy,test_macro_f1,test_accuracy\n"
              "a,\"A, first\",0.5,0.6,0.4,0.5\nb,B,0.5,0.7,0.3,0.5\n"})
    write_run(tmp_path / "model_benchmark", "old", {"model_comparison.csv":
              head + "macro_f1,accuracy\na,A,0.1,0.2\nb,B,0.3,0.2\n"})
    write_run(tmp_path / "model_benchmark", "unfinished", {})
    write_run(tmp_path / "qubit_stratified", "s", {"subgroup_model_comparison.csv":
              "qubit_count," + head + "validation_macro_f1,validation_accuracy,test_macro_f1,test_accuracy\n"
              "5,a,A,0.1,0.1,0.2,0.2\n5,b,B,0.2,0.1,0.1,0.2\n6,a,A,0.3,0.1,0.3,0.2\n"})
    write_run(tmp_path / "reliability_baseline", "r", {"model_comparison.csv":
              head + "validation_r2,validation_mae,test_r2,test_mae\na,A,0.5,0.2,0.4,0.1\nb,B,0.5,0.1,0.1,0.1\n"})
    write_run(tmp_path / "tuned_classification", "t", {
        "tuned_model_comparison.csv": head + "best_validation_macro_f1,test_accuracy,test_macro_f1,best_params\n"
        "a,A,0.5,0.5,0.5,\"{'d': 1, 'n': 2}\"\n",
        "subset_metadata.json": '{"filter_column": "qubit_count", "filter_value": "6"}'})
    write_run(tmp_path / "rf_baseline", "flat", {"metrics.json": '{"macro_f1": 0.4, "accuracy": 0.5}'})
    write_run(tmp_path / "rf_baseline", "nested", {"metrics.json":
              '{"model_name": "rf", "validation_metrics": {"macro_f1": 0.6}, "test_metrics": {"macro_f1": 0.7}}'})

    matrix_rows = experiment_matrix(spark, str(tmp_path)).collect()
    assert len(matrix_rows) == 2 + 2 + 3 + 2 + 1 + 2
    best = {(r["run_name"], r["subset_value"], r["model_name"]) for r in matrix_rows
            if r["is_best_validation_in_scope"]}
    assert best == {("new", None, "b"), ("s", "5", "b"), ("s", "6", "a"), ("r", None, "b"),
                    ("t", "6", "a"), ("nested", None, "rf")}
    by_run = {(r["run_name"], r["model_name"]): r for r in matrix_rows}
    assert by_run["new", "a"]["model_display_name"] == "A, first"
    assert by_run["old", "b"]["is_best_test_in_scope"] and by_run["old", "b"]["test_macro_f1"] == 0.3
    assert by_run["t", "a"]["best_params"] == "{'d': 1, 'n': 2}"
    flat = scan_single_model_runs(spark, str(tmp_path / "rf_baseline")).filter("run_name = 'flat'").first()
    assert (flat["model_name"], flat["test_macro_f1"]) == ("random_forest", 0.4)
    facts = {(r["measure"], r["item"]): r["value"] for r in inventory(
        experiment_matrix(spark, str(tmp_path))).collect()}
    assert facts["total_rows", "all"] == 12 and facts["total_runs", "all"] == 7
    assert facts["run_counts_by_family", "classification_global"] == 2


def test_tuning_verdicts(spark):
    tuned = spark.createDataFrame(
        [(1, "m", 0.6, 0.4), (2, "m", 0.4, 0.4), (3, "m", 0.6, 0.6), (4, "m", 0.4, 0.6), (5, "m", 0.6, 0.6)],
        "k int, model_name string, best_validation_macro_f1 double, test_macro_f1 double")
    untuned = spark.createDataFrame([(k, "u", 0.5, 0.5) for k in range(1, 5)],
                                    "k int, model_name string, validation_macro_f1 double, test_macro_f1 double")
    verdicts = [r["verdict"].split(":")[0] for r in compare_tuning(tuned, untuned, "k").orderBy("k").collect()]
    assert verdicts == ["overfitted", "no gain", "gain", "mixed", "no untuned reference"]


def scans(df) -> int:
    """Reads of the source table in the plan that runs."""

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") + plan.count("InMemoryRelation") + plan.count("LogicalRDD")


def test_rows_are_read_once_for_all_models(spark, tmp_path):
    """Scores of a suite are those of each model alone, from one scan however many models there are."""

    regression_rows(spark).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    specs = [ModelSpec(f"ridge {k}", lambda k=k: Ridge(alpha=float(k + 1), labelCol="y")) for k in range(4)] + [forest()]
    few, many = (fit_regressors(df, ["x", "c"], "y", some, release_prep, keep=["id"]) for some in (specs[:1], specs))
    assert scans(few.scored) == scans(many.scored) == 1
    held_out = df.filter("split_name <> 'train'")
    for name, model in many.models.items():
        alone = {(r["id"], r["prediction"]) for r in model.transform(held_out).collect()}
        rows = many.scored.filter(F.col("model_name") == name).collect()
        assert {(r["id"], r["predicted_value"]) for r in rows} == alone and len(rows) == held_out.count()

    labelled = df.withColumn("label", F.when(F.col("x") < 3, "low").otherwise("top"))
    specs = [ModelSpec("dummy", lambda: DummyClassifier(strategy="stratified", idCol="id")),
             ModelSpec("logistic", lambda: Logistic(maxIter=20)),
             ModelSpec("boosted", lambda: boosted_classifier(2, maxIter=2, maxDepth=2))]
    suite = fit_classifiers(labelled, ["x", "c"], "label", specs, keep=["id"])
    assert scans(suite.scored) == 1
    assert suite.scored.columns == ["split_name", "id", "model_name", "true_label", "predicted_label", "scores"]
    for name, model in suite.models.items():
        coded = labelled.filter("split_name <> 'train'")
        alone = {(r["id"], ["low", "top"][int(r["prediction"])]) for r in model.transform(coded).collect()}
        assert {(r["id"], r["predicted_label"]) for r in suite.scored.filter(
            F.col("model_name") == name).collect()} == alone


def test_search_tables_have_folds_ranks_and_seconds(spark):
    """Every score in every fold, three ranks; a setting without R² comes last instead of stopping the job."""

    rows = [(s, f, float(y), float(y) + e) for s, e in (("near", 0.1), ("far", 2.0)) for f in range(3)
            for y in range(4)] + [("lone", f, 1.0, 1.0) for f in range(3)]
    found = fold_results(spark.createDataFrame(rows, "setting string, fold int, y double, p double"), "y", "p")
    by = {r["setting"]: r for r in found.collect()}
    assert [r["setting"] for r in found.collect()][:2] == ["near", "far"]
    assert (by["near"]["rank_r2"], by["near"]["rank_mae"], by["lone"]["rank_mae"]) == (1, 2, 1)
    assert by["lone"]["mean_r2"] is None and by["lone"]["rank_r2"] == 3
    assert by["far"]["fold2_mae"] == pytest.approx(2.0) and by["far"]["std_mae"] == pytest.approx(0.0)
    train = regression_rows(spark).filter("split_name = 'train' and g < 2")
    spec = ModelSpec("ridge", lambda: Ridge(labelCol="y"), [{"alpha": 1.0}, {"alpha": 9.0}])
    single = train.groupBy("g").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    result = grouped_search(single, ["x"], "y", "g", [spec], folds=2)["ridge"]
    assert result.best == {"alpha": 1.0} and result.best_r2 is None
    assert {"fold0_r2", "fold1_rmse", "rank_rmse", "mean_fit_seconds", "std_fit_seconds"} <= set(result.results.columns)
    assert result.results.filter("mean_fit_seconds > 0").count() == 2


def test_preparations_of_parts_equal_single_fits(spark):
    """Parts of the rows are prepared together as each would be alone; a category that only one part has,
    a column without values in a part and NaN among them."""

    from sliceworks.models.prep import release_prep

    df = spark.range(60).select(
        (F.col("id") % 3).alias("fold"), F.when(F.col("id") == 4, "rare").otherwise(
            F.concat(F.lit("c"), F.col("id") % 2)).alias("c"), (F.col("id") % 4 == 0).alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit(float("nan")))
        .otherwise(F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 3 == 1, F.col("id")).alias("n"))
    parts = [*[F.col("fold") != k for k in range(3)], F.col("fold") == 1, F.col("fold") == 0, F.lit(True)]
    for features in (["c", "b", "x", "n"], ["c"], ["x"]):
        prep = release_prep(features)
        for part, ready in zip(parts, prep.fit_parts(df, parts), strict=True):
            if features == ["x"] and part is parts[4]:
                continue  # nothing is left to prepare
            alone = prep.fit(df.filter(part))
            rows = [[r["features"] for r in model.transform(df.orderBy("c", "x", "n")).select("features").collect()]
                    for model in (ready, alone)]
            assert [v.toArray().tolist() for v in rows[0]] == [v.toArray().tolist() for v in rows[1]]


def test_regimes_compute_their_rows_once(spark):
    """Regimes of the same variants share rows and folds, and the input is computed once for all regimes."""

    computed = spark.sparkContext.accumulator(0)

    def seen(y):
        computed.add(1)
        return y

    df = regression_rows(spark).withColumn("v", F.when(F.col("id") % 2 == 0, "p").otherwise("q")).withColumn(
        "g", F.when(F.col("g") > 0, F.col("g"))).withColumn("y", F.udf(seen, "double")("y")).withColumn(
        "z", F.when(F.col("v") == "q", F.col("x") + F.col("y")))
    regimes = [Regime("one", ("p",)), Regime("both", ("p", "q"), with_variant=True),
               Regime("more", ("q", "p"), with_local=True)]
    spec = ModelSpec("ridge", lambda: Ridge(labelCol="y"), [{"alpha": 1.0}, {"alpha": 9.0}])
    study = regime_study(df, regimes=regimes, models=[spec], target="y", group="g", variant="v",
                         shared=["x", "c"], local=["z"], folds=2)
    assert computed.value == 240
    assert {r["ablation_name"]: (r["feature_column_count"], r["used_local_feature_count"])
            for r in study.summary.collect()} == {"one": (2, 0), "both": (3, 0), "more": (3, 1)}
    for regime, features in zip(regimes, (["x", "c"], ["x", "c", "v"], ["x", "c", "z"]), strict=True):
        train = df.filter(F.col("v").isin(*regime.variants) & (F.col("split_name") == "train"))
        alone = grouped_search(train, features, "y", "g", [spec], folds=2)["ridge"]
        best = study.summary.filter(F.col("ablation_name") == regime.name).first()
        assert best["cv_best_r2"] == pytest.approx(alone.best_r2) and best["best_params"] == str(alone.best)
        assert study.models[regime.name, "ridge"].stages[-1].coefficients.toArray() == pytest.approx(
            alone.model.stages[-1].coefficients.toArray())


def test_grouped_linear_models_equal_single_fits(spark):
    """Ridge and logistic regression of all groups at once against a fit for each; a group with one
    class, one with few rows, and one with most of the rows among them."""

    from sliceworks.models.grouped import grouped_logistic, grouped_probabilities, grouped_ridge

    dice = np.random.RandomState(3)
    rows = []
    for g, n in (("a", 300), ("b", 40), ("c", 9), ("one", 12)):
        for _ in range(n):
            x = dice.normal(size=3) * (1, 10, 0.1) + (0, 1000, 0)
            z = x[0] + 0.1 * (x[1] - 1000) + dice.normal()
            three = 0 if g == "one" else int(z > 0) + int(z > 1.2)
            rows.append((g, *map(float, x), float(z + 5), float(min(three, 1)), float(three)))
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, y double, two double, three double"
                               ).repartition(5)
    names = ["x0", "x1", "x2"]
    whole = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    found = {r["g"]: r for r in grouped_ridge(df, "g", names, "y", 0.7).collect()}
    for g in ("a", "b", "c", "one"):
        single = Ridge(alpha=0.7, labelCol="y").fit(whole.filter(F.col("g") == g))
        assert found[g]["coefficients"] == pytest.approx(single.coefficients.toArray(), abs=1e-6)
        assert found[g]["intercept"] == pytest.approx(single.intercept, abs=1e-4)
    for label, classes, balanced in (("two", 2, False), ("two", 2, True), ("three", 3, False)):
        models = grouped_logistic(whole, "g", classes, c=0.5, balanced=balanced, label=label)
        scored = {(r["g"], r["x0"]): r["scores"] for r in grouped_probabilities(whole, models, "g").collect()}
        for g in ("a", "b", "c"):
            part = whole.filter(F.col("g") == g)
            single = Logistic(c=0.5, maxIter=500, balanced=balanced, labelCol=label).fit(part)
            for r in single.transform(part).select("x0", vector_to_array("probability").alias("p")).collect():
                assert scored[g, r["x0"]][:len(r["p"])] == pytest.approx(r["p"], abs=2e-3), (g, label)
        assert all(scored[r[0], r[1]][0] == 1.0 for r in rows if r[0] == "one")


def test_subgroups_are_split_as_one_by_one(spark):
    from sliceworks.operators.splits import split_stratified, split_stratified_by

    rows = [(k, "big", f"y{k % 3}") for k in range(400)] + [(1000 + k, "tiny", f"y{k}") for k in range(5)] + [
        (2000 + k, "lean", "y0" if k < 50 else "y1") for k in range(53)] + [(3000, None, None)]
    df = spark.createDataFrame(rows, "id int, g string, y string").repartition(4)
    found = {r["id"]: r["split_name"] for r in split_stratified_by(df, "g", ["id"], "y").collect()}
    expected = {}
    for g in ("big", "tiny", "lean"):
        expected |= {r["id"]: r["split_name"] for r in split_stratified(df.filter(F.col("g") == g), ["id"], "y").collect()}
    assert found == expected


def test_subgroup_suites_fit_all_groups_together(spark):
    from sliceworks.models.suites import classifier_comparison, fit_per_group

    df = regression_rows(spark).withColumn("g", F.when(F.col("id") % 3 > 0, "p").when(F.col("id") > 9, "q")).withColumn(
        "label", F.when(F.col("x") + F.when(F.col("g") == "p", 0).otherwise(2) > 3, "high").otherwise("low"))
    scored = fit_per_group(df.drop("split_name"), "g", ["x", "c"], "label", ["id"], [
        ModelSpec("dummy", lambda: DummyClassifier()), ModelSpec("logistic", lambda: Logistic(c=100.0)),
        ModelSpec("boosted", lambda: boosted_classifier(2, maxIter=2, maxDepth=2))])
    found = {(r["g"], r["model_name"]): r["test_accuracy"] for r in classifier_comparison(scored, ["g", "model_name"]).collect()}
    assert set(found) == {(g, m) for g in "pq" for m in ("dummy", "logistic", "boosted")}
    assert found["p", "logistic"] == found["q", "logistic"] == 1.0 > found["p", "dummy"]
