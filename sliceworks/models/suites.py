"""Fitting and scoring suites of models on one split table, grouped search, tuning, studies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import or_
from statistics import mean, pstdev
from typing import NamedTuple

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from sliceworks.checks import fresh_name, require_columns
from sliceworks.models.estimators import DummyClassifier, Logistic, ModelSpec
from sliceworks.models.grouped import grouped_logistic, grouped_probabilities
from sliceworks.models.prep import Prep, classification_prep, release_prep, vector_names
from sliceworks.operators.categories import few_rows
from sliceworks.operators.metrics import (
    classification_metrics, regression_measures, regression_metrics,
)
from sliceworks.operators.ordering import if_small
from sliceworks.operators.policy import fixed_split_design
from sliceworks.operators.slices import pivot_splits, predictions
from sliceworks.operators.splits import grouped_folds, split_stratified_by, subset_folds
from sliceworks.operators.subsets import filter_variants
from sliceworks.session import fresh_path, written
from sliceworks.sources.tables import read_predictions, write_predictions


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a table in memory and on disk while models are fitted to it repeatedly."""

    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def stacked(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name."""

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fit_settings(
    learner: Estimator, prepared: DataFrame, maps: Sequence[dict[Param, object]], parallelism: int
) -> list[tuple[Model, float]]:
    """One model per setting with its fit's seconds, a few at a time, all on the same prepared rows."""

    fits = learner.fitMultiple(prepared, maps)

    def timed(_) -> tuple[int, Model, float]:
        start = time.perf_counter()
        return *next(fits), time.perf_counter() - start

    step = inheritable_thread_target(prepared.sparkSession)(timed)
    with ThreadPool(max(1, min(parallelism, len(maps)))) as pool:
        found = {i: (model, seconds) for i, model, seconds in pool.imap_unordered(step, range(len(maps)))}
    return [found[i] for i in range(len(maps))]


def model_importance(model: PipelineModel, prepared: DataFrame, vector: str = "features"
                     ) -> DataFrame | None:
    """Tree importances or absolute coefficients, largest first; null when a model has none."""

    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficientMatrix"):
        values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(fitted, "coefficients"):
        values = abs(fitted.coefficients.toArray())
    else:
        return None
    names = vector_names(prepared, vector)
    rows = [(name, float(v)) for (name, _), v in zip(names, values, strict=True)]
    return prepared.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def fan_out(prepared: DataFrame, models: Mapping[object, Model], keep: Sequence[str],
            keys: Callable[[object], dict[str, Column]]) -> DataFrame:
    """One row per prepared row and model: what is kept, the model's keys, ``prediction`` and ``scores``.

    The models run one after the other on the same row, which is then taken apart once, so the rows
    are read and prepared once however many models there are.
    """

    made = ("prediction", "probability", "rawPrediction", "scores", "label_scores")
    carried = dict.fromkeys([*keep])
    rows, results = prepared.select(*carried, "features"), []
    for k, (name, model) in enumerate(models.items()):
        out = model.transform(rows)
        scores = next((vector_to_array(c) if c != "scores" else F.col(c) for c in ("probability", "rawPrediction",
                       "scores") if c in out.columns and c not in carried), F.lit(None).cast("array<double>"))
        labels = [column.alias(c) for c, column in keys(name).items()]
        result = F.struct(*labels, F.col("prediction").cast("double").alias("prediction"), scores.alias("scores"))
        rows = out.withColumn(f"_result{k}", result).drop(*[c for c in made if c not in carried])
        results.append(f"_result{k}")
    if not results:
        raise ValueError("There is no model to score with.")
    return rows.select(*carried, F.explode(F.array(*results)).alias("_result")).select(*carried, "_result.*")


def shared_preparation(models: Mapping[object, PipelineModel]) -> tuple[PipelineModel, dict] | None:
    """The preparation that all pipelines share, and their learners; null if they differ."""

    parts = {name: (model.stages[:-1], model.stages[-1]) for name, model in models.items()}
    preparations = [tuple(map(id, stages)) for stages, _ in parts.values()]
    if len(set(preparations)) != 1:
        return None
    return PipelineModel(list(next(iter(parts.values()))[0])), {n: learner for n, (_, learner) in parts.items()}


# -- regression -------------------------------------------------------------------------------

def score_all(models: Mapping[str, PipelineModel], df: DataFrame, *, target: str, ablation: str = "all",
              keep: Sequence[str] = ()) -> DataFrame:
    """Prediction rows of all models for every split of a table, which is read once where the models
    share their preparation."""

    shared = shared_preparation(models)
    if shared is None:
        return stacked(score(model, df, target=target, name=name, ablation=ablation, keep=keep)
                       for name, model in models.items())
    ready, learners = shared
    columns = list(dict.fromkeys(["split_name", *keep, target]))
    scored = fan_out(ready.transform(df), learners, columns, lambda name: {"_model": F.lit(name)})
    return predictions(scored.select(*columns, "prediction", "_model"), truth=target,
                       predicted="prediction", ablation=ablation, model=F.col("_model")).drop("_model")


def score(model: PipelineModel, df: DataFrame, *, target: str, name: str, ablation: str = "all",
          keep: Sequence[str] = ()) -> DataFrame:
    """Prediction rows of one model for every split of a table."""

    scored = model.transform(df).select(
        *dict.fromkeys(["split_name", *keep, target]), "prediction")
    return predictions(scored, truth=target, predicted="prediction", ablation=ablation, model=name)


def comparison(scored: DataFrame) -> DataFrame:
    """One row per regime and model: validation and test MAE, RMSE, R²."""

    metrics = regression_metrics(scored, ["split_name", "ablation_name", "model_name"])
    return pivot_splits(metrics, ["ablation_name", "model_name"], ["mae", "rmse", "r2"])


class Suite(NamedTuple):
    """Fitted pipelines by name, and the prediction rows of validation and test."""

    models: dict[str, PipelineModel]
    scored: DataFrame


def fit_regressors(
    df: DataFrame, features: Sequence[str], target: str, specs: Sequence[ModelSpec],
    prep: Callable[[Sequence[str]], object], *, ablation: str = "all", keep: Sequence[str] = (),
) -> Suite:
    """Fit every model on the train rows and score validation and test.

    Numbers are parsed once, the train rows are held while the models are fitted.
    """

    table = df.withColumn(target, F.col(target).cast("double"))
    train = table.filter(F.col("split_name") == "train")
    ready = prep(features).fit(train)  # the preparation is the same for every model
    with kept(ready.transform(train).select("features", target)) as prepared:
        models = {spec.name: PipelineModel([ready, spec.build().fit(prepared)]) for spec in specs}
    held_out = table.filter(F.col("split_name") != "train")
    return Suite(models, score_all(models, held_out, target=target, ablation=ablation, keep=keep))


# -- grouped search ---------------------------------------------------------------------------

class SearchResult(NamedTuple):
    """The refitted best pipeline, its settings, its mean R², and the results per setting."""

    model: PipelineModel
    best: dict[str, object]
    best_r2: float | None
    results: DataFrame


#: Scores of a search and whether the best is the largest.
SCORES = {"r2": True, "mae": False, "rmse": False}


def fold_results(scored: DataFrame, truth: str, predicted: str, settings: str = "setting",
                 fold: str = "fold", by: Sequence[str] = (), folds: int | None = None) -> DataFrame:
    """Cross-validation table from out-of-fold predictions: each score in each fold, its mean,
    deviation and rank, all from one aggregation by fold and setting.

    Ordered by R² rank, then MAE. A setting without a score, such as R² on folds of one row, ranks last.
    """

    measures = regression_measures(truth, predicted)
    per_fold = scored.groupBy(*by, settings, fold).agg(*[m.alias(n) for n, m in measures.items()])
    if folds is None:
        folds = (per_fold.agg(F.max(fold)).first()[0] or 0) + 1
    summary = per_fold.groupBy(*by, settings).agg(
        *[F.max(F.when(F.col(fold) == k, F.col(m))).alias(f"fold{k}_{m}") for m in SCORES for k in range(folds)],
        *[f(m).alias(f"{name}_{m}") for m in SCORES for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    # one row per setting tried
    among = Window.partitionBy(*(by or [F.lit(1)]))
    order = {m: F.desc_nulls_last(f"mean_{m}") if largest else F.asc_nulls_last(f"mean_{m}")
             for m, largest in SCORES.items()}
    return summary.withColumns({f"rank_{m}": F.rank().over(among.orderBy(o)) for m, o in order.items()}
                               ).orderBy("rank_r2", "mean_mae")


def _param_maps(learner: Estimator, grid: Sequence[Mapping[str, object]]
                ) -> list[dict[Param, object]]:
    return [{learner.getParam(name): value for name, value in setting.items()} for setting in grid]


def grouped_search(
    train: DataFrame, features: Sequence[str], target: str, group: str,
    specs: Sequence[ModelSpec], *, folds: int = 3, parallelism: int = 4,
    prep: Callable[[Sequence[str]], Prep] = release_prep, dealt: str | None = None,
) -> dict[str, SearchResult]:
    """Try every setting of every model by grouped cross-validation; refit the best by mean R².

    The preparation is fitted for each fold, on that fold's training rows, and shared by all models and
    settings; those of all folds and the last one take their passes together. All out-of-fold rows are
    scored in one job. ``dealt`` names a column with the groups' folds, where rows that are held
    already have one.
    """

    rows = train.withColumn(target, F.col(target).cast("double"))
    if dealt is None:
        assigned = grouped_folds(train, group, folds)
        rows = rows.join(assigned.select(F.col(group).alias("_group_of_fold"), "fold"),
                         F.col(group).eqNullSafe(F.col("_group_of_fold")))
    else:
        rows = rows.withColumn("fold", F.col(dealt))
    rows = rows.select(*dict.fromkeys([*features, target, "fold"]))
    learners = {spec.name: spec.build() for spec in specs}
    maps = {spec.name: _param_maps(learners[spec.name], spec.grid) for spec in specs}
    with nullcontext(rows) if dealt else kept(rows) as table:
        largest = table.agg(F.max("fold")).first()[0]
        if largest is None or largest < 1:
            raise ValueError("Grouped cross-validation needs at least two groups.")
        scored, seconds = [], {}
        outside = [F.col("fold") != fold for fold in range(largest + 1)]  # fewer groups than folds leave folds empty
        *by_fold, whole = prep(features).fit_parts(table, [*outside, F.lit(True)])
        for fold, ready in enumerate(by_fold):
            fit_rows = table.filter(outside[fold])
            held = ready.transform(table.filter(F.col("fold") == fold))
            with kept(ready.transform(fit_rows).select("features", target)) as prepared:
                fitted = {(name, i): fit for name, learner in learners.items()
                          for i, fit in enumerate(fit_settings(learner, prepared, maps[name], parallelism))}
            for key, (_, took) in fitted.items():
                seconds.setdefault(key, []).append(took)
            scored.append(fan_out(held, {key: model for key, (model, _) in fitted.items()}, ["fold", target],
                                  lambda key: {"model_name": F.lit(key[0]), "setting_index": F.lit(key[1])}))
        # one row per model and setting
        tried = fold_results(stacked(scored), target, "prediction", "setting_index",
                             by=["model_name"], folds=largest + 1).collect()
        measures = [*(f"fold{k}_{m}" for m in SCORES for k in range(largest + 1)),
                    *(f"{name}_{m}" for m in SCORES for name in ("mean", "std"))]
        ranks = [f"rank_{m}" for m in SCORES]
        found = {}
        with kept(whole.transform(table).select("features", target)) as prepared:
            for spec in specs:
                mine = [r for r in tried if r["model_name"] == spec.name]
                top = min(mine, key=lambda r: (r["mean_r2"] is None, -(r["mean_r2"] or 0.0), r["setting_index"]))
                best = top["setting_index"]
                model = learners[spec.name].fit(prepared, maps[spec.name][best])
                took = lambda r: seconds[r["model_name"], r["setting_index"]]
                results = train.sparkSession.createDataFrame(
                    [(str(dict(spec.grid[r["setting_index"]])), *[r[m] for m in measures + ranks],
                      mean(took(r)), pstdev(took(r))) for r in mine],
                    "setting string, " + ", ".join(f"{m} double" for m in measures) + ", "
                    + ", ".join(f"{m} int" for m in ranks) + ", mean_fit_seconds double, std_fit_seconds double")
                found[spec.name] = SearchResult(
                    PipelineModel([whole, model]), dict(spec.grid[best]), top["mean_r2"], results)
    return found


# -- classification ---------------------------------------------------------------------------

class ClassifierSuite(NamedTuple):
    """Fitted pipelines by name, prediction rows, and the labels in order."""

    models: dict[str, PipelineModel]
    scored: DataFrame
    labels: list[str]


def score_classes(model: PipelineModel, df: DataFrame, labels: Sequence[str], *, label: str,
                  name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction rows with the label text, the predicted text and the class scores."""

    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("scores", vector_to_array("probability"))
    elif "rawPrediction" in out.columns:
        out = out.withColumn("scores", vector_to_array("rawPrediction"))
    decoded = IndexToString(inputCol="prediction", outputCol="predicted_label",
                            labels=list(labels)).transform(out)
    return decoded.select(
        *dict.fromkeys(["split_name", *keep]), F.lit(name).alias("model_name"),
        F.col(label).cast("string").alias("true_label"), "predicted_label", "scores")


def score_all_classes(models: Mapping[object, PipelineModel], df: DataFrame, labels: Sequence[str], *,
                      label: str, keep: Sequence[str] = (), needs: Sequence[str] = (),
                      key: str = "model_name") -> DataFrame:
    """The same for all models, reading the rows once where they share their preparation; ``needs`` are
    columns that models read beside the features."""

    shared = shared_preparation(models)
    if shared is None:
        return stacked(score_classes(model, df, labels, label=label, name=name, keep=keep)
                       for name, model in models.items())
    ready, learners = shared
    columns = list(dict.fromkeys(["split_name", *keep]))
    scored = fan_out(ready.transform(df), learners, [*dict.fromkeys([*columns, label, *needs])],
                     lambda name: {"_model": F.lit(name)})
    decoded = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    return scored.select(*columns, F.col("_model").alias(key), F.col(label).cast("string").alias("true_label"),
                         decoded.alias("predicted_label"), "scores")


def encode_label(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """The label as text, its code in column ``label_code`` and the labels in code order."""

    table = df.withColumn(label, F.col(label).cast("string"))
    few_rows(table.select(label).distinct(), f"labels in {label!r}")
    codes = StringIndexer(inputCol=label, outputCol="label_code",
                          stringOrderType="alphabetAsc").fit(table)
    return codes.transform(table), list(codes.labels)


def _for_label(spec: ModelSpec) -> Estimator:
    learner = spec.build()
    return learner.copy({learner.getParam("labelCol"): "label_code"})


def _ids(specs: Sequence[ModelSpec]) -> list[str]:
    """Row ids that random guessers read."""

    learners = [spec.build() for spec in specs]
    return sorted({x.getOrDefault("idCol") for x in learners if x.hasParam("idCol")} - {""})


def fit_classifiers(
    df: DataFrame, features: Sequence[str], label: str, specs: Sequence[ModelSpec], *,
    keep: Sequence[str] = (),
) -> ClassifierSuite:
    """Fit every classifier on the train rows of one split and score the others."""

    coded, labels = encode_label(df, label)
    train = coded.filter(F.col("split_name") == "train")
    ready = classification_prep(features).fit(train)
    with kept(ready.transform(train).select("features", "label_code", *_ids(specs))) as prepared:
        models = {spec.name: PipelineModel([ready, _for_label(spec).fit(prepared)])
                  for spec in specs}
    held_out = coded.filter(F.col("split_name") != "train")
    return ClassifierSuite(models, score_all_classes(
        models, held_out, labels, label=label, keep=keep, needs=_ids(specs)), labels)


def classifier_comparison(scored: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """One row per model: validation and test accuracy and F1 scores."""

    metrics = classification_metrics(scored, "true_label", "predicted_label",
                                     ["split_name", *keys])
    return pivot_splits(metrics, keys, ["accuracy", "macro_f1", "weighted_f1"])


def fit_per_group(
    df: DataFrame, group: str, features: Sequence[str], label: str, id_columns: Sequence[str],
    specs: Sequence[ModelSpec],
) -> DataFrame:
    """The suite for each subgroup with a split of its own; prediction rows with the key. Rows without
    a group are left out.

    All subgroups are split, prepared and, for the majority and the logistic classifier, fitted and scored
    together; slots that only other subgroups fill get no weight. Tree learners, which have no sums to
    share, are fitted subgroup by subgroup, each on its own rows. ``scores`` are by the labels of all
    subgroups in order, 0 for those a subgroup does not have.
    """

    used = [c for c in features if c != group]
    coded, labels = encode_label(df.filter(F.col(group).isNotNull()), label)
    split = written(split_stratified_by(coded, group, id_columns, label), "subgroups")
    train, held_out = (split.filter(F.col("split_name") == "train"), split.filter(F.col("split_name") != "train"))
    ready = classification_prep(used).fit(train)
    decoded = F.get(F.array(*[F.lit(x) for x in labels]), F.col("_best").cast("int"))
    parts = []
    with kept(ready.transform(train).select(group, "features", "label_code")) as fit_rows:
        for spec in specs:
            learner = spec.build()
            if isinstance(learner, Logistic):
                models = written(grouped_logistic(
                    fit_rows, group, len(labels), c=learner.getOrDefault("c"),
                    balanced=learner.getOrDefault("balanced")), "subgroup-models")
                scored = grouped_probabilities(ready.transform(held_out), models, group)
                scored = scored.withColumn("_best", F.array_position("scores", F.array_max("scores")) - 1)
            elif isinstance(learner, DummyClassifier) and learner.getOrDefault("strategy") == "most_frequent":
                counts = fit_rows.groupBy(group, "label_code").agg(F.count(F.lit(1)).alias("n"))
                top = counts.groupBy(F.col(group).alias("_top_of")).agg(F.min(F.struct(
                    -F.col("n"), F.col("label_code")))["label_code"].alias("_best"))
                scored = held_out.join(if_small(top), F.col(group) == F.col("_top_of")).withColumn(
                    "scores", F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda k: (
                        k == F.col("_best").cast("int")).cast("double")))
            else:
                parts.append(_fit_one_by_one(split, group, used, label, spec))
                continue
            parts.append(scored.select(
                "split_name", F.lit(spec.name).alias("model_name"), F.col(label).alias("true_label"),
                decoded.alias("predicted_label"), "scores", group))
    return stacked(parts)


def _fit_one_by_one(split: DataFrame, group: str, features: Sequence[str], label: str, spec: ModelSpec) -> DataFrame:
    keys = sorted(row[0] for row in few_rows(split.select(group).distinct(), f"subgroups in {group!r}"))
    return stacked(fit_classifiers(split.drop("label_code").filter(F.col(group) == key), features, label, [spec])
                   .scored.withColumn(group, F.lit(key)) for key in keys)


class Tuned(NamedTuple):
    """The refitted best pipelines, a row per setting tried, and a row per model."""

    models: dict[str, PipelineModel]
    tried: DataFrame
    comparison: DataFrame


def _base(learner: Estimator) -> Estimator:
    """The learner that owns the settings: the inner one of a one-against-the-rest learner."""

    return learner.getClassifier() if isinstance(learner, OneVsRest) else learner


def tune_classifiers(
    df: DataFrame, features: Sequence[str], label: str, specs: Sequence[ModelSpec], *,
    parallelism: int = 4,
) -> Tuned:
    """Choose settings on validation (the first strictly best macro-F1), refit on train plus
    validation, score test."""

    coded, labels = encode_label(df, label)
    models, tried, chosen = {}, [], []
    with kept(coded) as table:
        in_split = lambda *names: table.filter(F.col("split_name").isin(*names))
        first = classification_prep(features).fit(in_split("train"))
        final = classification_prep(features).fit(in_split("train", "validation"))
        with (
            kept(first.transform(in_split("train")).select("features", "label_code")) as fit_rows,
            kept(final.transform(in_split("train", "validation")).select(
                "features", "label_code")) as refit_rows,
        ):
            for spec in specs:
                learner = _for_label(spec)
                maps = _param_maps(_base(learner), spec.grid)
                candidates = [PipelineModel([first, model]) for model, _ in
                              fit_settings(learner, fit_rows, maps, parallelism)]
                scored = score_all_classes(dict(enumerate(candidates)), in_split("validation"), labels,
                                           label=label, key="setting")
                metrics = {r["setting"]: r for r in classification_metrics(
                    scored, "true_label", "predicted_label", ["setting"]).collect()}
                tried += [(spec.name, i, str(dict(spec.grid[i])), metrics[i]["accuracy"],
                           metrics[i]["macro_f1"]) for i in range(len(maps))]
                best = max(range(len(maps)), key=lambda i: (metrics[i]["macro_f1"], -i))
                models[spec.name] = PipelineModel([final, learner.fit(refit_rows, maps[best])])
                chosen.append((spec.name, metrics[best], str(dict(spec.grid[best]))))
        on_test = {r["model_name"]: r for r in classification_metrics(
            score_all_classes(models, in_split("test"), labels, label=label),
            "true_label", "predicted_label", ["model_name"]).collect()}
    rows = [(name, top["macro_f1"], on_test[name]["accuracy"], on_test[name]["macro_f1"], setting)
            for name, top, setting in chosen]
    spark = df.sparkSession
    return Tuned(
        models,
        spark.createDataFrame(tried, "model_name string, setting_index int, setting string, "
                              "validation_accuracy double, validation_macro_f1 double"),
        spark.createDataFrame(rows, "model_name string, best_validation_macro_f1 double, "
                              "test_accuracy double, test_macro_f1 double, best_params string"),
    )


# -- regime study -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Regime:
    """Which variants take part and which feature groups are used."""

    name: str
    variants: tuple[str, ...]
    with_variant: bool = False
    with_local: bool = False


def standard_regimes(base: str = "raw", other: str = "transpiled") -> list[Regime]:
    """The five regimes: each variant alone, both, and both with the variant as a feature,
    without and with the local features."""

    return [
        Regime("raw_only", (base,)),
        Regime("transpiled_only", (other,), with_local=True),
        Regime("both", (base, other)),
        Regime("both_without_local_features", (base, other), with_variant=True),
        Regime("both_with_local_features", (base, other), with_variant=True, with_local=True),
    ]


class Study(NamedTuple):
    """All prediction rows, a row per regime and model, the search tables, the fitted models."""

    scored: DataFrame
    summary: DataFrame
    search: DataFrame
    models: dict[tuple[str, str], PipelineModel]


def regime_study(
    df: DataFrame, *, regimes: Sequence[Regime], models: Sequence[ModelSpec], target: str,
    group: str, variant: str, shared: Sequence[str], local: Sequence[str],
    keep: Sequence[str] = (), folds: int = 3, parallelism: int = 4, folder: str | None = None,
) -> Study:
    """Every model in every regime: filter variants, drop train-constant columns, grouped search,
    score validation and test. The split table must have passed its audit.

    The table is computed once for all regimes; regimes of the same variants share their folds and their
    train rows, which are held. Predictions are written regime by regime (to ``folder``, else the shared one) and
    read back as one partitioned table, on which all later metrics run.
    """

    path = folder or fresh_path(df.sparkSession, "regime-predictions")
    fitted, searches, rows = {}, [], []
    needed = list(dict.fromkeys(["split_name", group, variant, target, *shared, *keep,
                                 *(local if any(r.with_local for r in regimes) else ())]))
    require_columns(df, needed)
    alike: dict[frozenset, list[int]] = {}
    for k, regime in enumerate(regimes):
        alike.setdefault(frozenset(regime.variants), []).append(k)
    is_train, allowed = F.col("split_name") == "train", {v: F.col(variant).isin(*v) for v in alike}
    table = written(df.filter(reduce(or_, allowed.values())).select(
        *[F.col(c).cast("string").alias(c) if c == group else c for c in needed]), "regime-rows")
    dealt, key = {v: fresh_name(table, f"fold_of_set{k}") for k, v in enumerate(alike)}, fresh_name(table, "group_of_fold")
    assigned = written(subset_folds(table, group, folds, {dealt[v]: is_train & allowed[v] for v in alike}
                                    ).withColumnRenamed(group, key), "regime-folds")
    found: dict[int, tuple[list[str], dict[str, SearchResult]]] = {}
    for variants, members in alike.items():
        variant_rows = filter_variants(table, variant, regimes[members[0]].variants)
        # rows without a group are a group too
        with kept(variant_rows.filter(is_train).join(assigned.select(key, dealt[variants]).dropna(
                subset=[dealt[variants]]), F.col(group).eqNullSafe(F.col(key))).drop(key)) as train:
            for k in members:
                regime = regimes[k]
                features = list(dict.fromkeys([
                    *shared, *([variant] if regime.with_variant else []),
                    *(local if regime.with_local else ())]))
                extra = [c for c in dict.fromkeys([*keep, variant]) if c not in features]
                design = fixed_split_design(variant_rows, target=target, features=features, group=group,
                                            strict=True, keep=extra, train=train)
                used = [c for c in features if c in design.columns]
                # a slice column that was a constant feature is gone from the design
                carried = [c for c in dict.fromkeys([*keep, variant, group]) if c in design.columns]
                result = grouped_search(train, used, target, group, models, folds=folds,
                                        parallelism=parallelism, dealt=dealt[variants])
                held_out = design.filter(F.col("split_name") != "train")
                write_predictions(score_all({name: r.model for name, r in result.items()}, held_out,
                                            target=target, ablation=regime.name, keep=carried), path)
                found[k] = used, result
    for k, regime in enumerate(regimes):
        used, results = found[k]
        for name, result in results.items():
            fitted[regime.name, name] = result.model
            searches.append(result.results.select(
                F.lit(regime.name).alias("ablation_name"), F.lit(name).alias("model_name"), "*"))
            rows.append((regime.name, name, len(used), sum(c in local for c in used),
                         result.best_r2, str(result.best)))
    scored = read_predictions(df.sparkSession, path)
    facts = df.sparkSession.createDataFrame(
        rows, "ablation_name string, model_name string, feature_column_count int, "
        "used_local_feature_count int, cv_best_r2 double, best_params string")
    summary = comparison(scored).join(facts, ["ablation_name", "model_name"])
    return Study(scored, summary, stacked(searches), fitted)
