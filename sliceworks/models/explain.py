"""Explanations: permutation importance and additive attributions of linear and tree models.

All of them work on a sample whose size is an argument of the operator, as costly explanations
do; everything around the sample stays distributed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceworks.models.prep import vector_names
from sliceworks.operators.ordering import order_key, small_table
from sliceworks.operators.splits import sample_rows
from sliceworks.session import fresh_path

LINEAR = ("ridge_regression", "logistic_regression")
TREES = ("random_forest_regressor", "boosted_regressor", "random_forest", "boosted_trees")


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], target: str,
    id_columns: Sequence[str], *, max_rows: int = 5000, repeats: int = 8, seed: int = 42,
) -> DataFrame:
    """Mean and deviation, over repeats, of the MAE rise when one feature is shuffled.

    Each shuffle pairs the rows' ranks in two hash orders. All features and repeats are tagged,
    stacked and scored in one job.
    """

    key = order_key(seed, *id_columns)
    sample = sample_rows(df, id_columns, max_rows, seed=seed).select(
        *dict.fromkeys([*id_columns, *features, target]))
    # at most max_rows rows in each of these windows: one per repeat
    base = sample.withColumn("_place", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(key, *id_columns)))
    donors = (
        sample.select(*features, *id_columns)
        .withColumn("_repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
        .withColumn("_place", F.row_number().over(Window.partitionBy("_repeat").orderBy(
            F.md5(F.concat_ws("|", F.lit("shuffle"), "_repeat", key)), *id_columns)))
        .select("_repeat", "_place", F.struct(*features).alias("_donor"))
    )
    paired = base.join(donors, "_place")
    tagged = paired.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features])))
    for f in features:
        tagged = tagged.withColumn(
            f, F.when(F.col("_feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)))
    shuffled = tagged.drop("_donor", "_place")
    plain = sample.withColumns({"_feature": F.lit(None).cast("string"),
                                "_repeat": F.lit(None).cast("int")})
    scored = model.transform(shuffled.unionByName(plain))
    mae = scored.groupBy("_feature", "_repeat").agg(
        F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"))
    # one row per feature and repeat; the plain row carries the reference to all of them
    reference = F.max(F.when(F.col("_feature").isNull(), F.col("mae"))).over(
        Window.partitionBy(F.lit(1)))
    return (
        mae.withColumn("_rise", F.col("mae") - reference).filter("_feature is not null")
        .groupBy(F.col("_feature").alias("feature"))
        .agg(F.avg("_rise").alias("importance_mean"), F.stddev_pop("_rise").alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def best_classifier(models: dict[str, PipelineModel], comparison: DataFrame) -> str:
    """Name of the explainable model with the best validation macro-F1, then accuracy."""

    allowed = [name for name in models if name in (*LINEAR, *TREES)]
    return comparison.filter(F.col("model_name").isin(*allowed)).orderBy(
        F.desc_nulls_last("validation_macro_f1"), F.desc_nulls_last("validation_accuracy"),
        "model_name").first()["model_name"]


class Attributions(NamedTuple):
    """Values and inputs per row and slot, importance per slot and per source column, facts."""

    values: DataFrame
    by_slot: DataFrame
    by_source: DataFrame
    metadata: dict[str, object]


def _prepared(model: PipelineModel, df: DataFrame) -> DataFrame:
    return PipelineModel(model.stages[:-1]).transform(df)


def _slot_table(prepared: DataFrame):
    names = vector_names(prepared)
    rows = [(i, slot, source) for i, (slot, source) in enumerate(names)]
    return small_table(
        prepared.sparkSession, rows, "slot_index int, feature string, source_feature string")


def linear_values(
    prepared: DataFrame, coefficients: Sequence[Sequence[float]], background: DataFrame,
    id_columns: Sequence[str],
) -> DataFrame:
    """Exact attributions of a linear model: coefficient times distance from the background
    mean, one row per explained row, class and slot. One coefficient vector per class."""

    slots = background.select(F.posexplode(vector_to_array("features")).alias("slot_index", "x"))
    weights = small_table(
        prepared.sparkSession,
        [(k, i, float(c)) for k, vector in enumerate(coefficients) for i, c in enumerate(vector)],
        "class_index int, slot_index int, coefficient double")
    means = slots.groupBy("slot_index").agg(F.avg("x").alias("center")).join(weights, "slot_index")
    long = prepared.select(*id_columns, F.posexplode(vector_to_array("features"))
                           .alias("slot_index", "input"))
    return long.join(means, "slot_index").select(
        *id_columns, "class_index", "slot_index", "input",
        (F.col("coefficient") * (F.col("input") - F.col("center"))).alias("attribution"))


# -- trees ------------------------------------------------------------------------------------

class Tree(NamedTuple):
    """One tree as arrays by node, level after level with siblings side by side; the root is node 0.

    A node is described by the edge that leads to it: the feature asked there, the interval or, as a
    row of ``categories``, the codes that lead this way (-1: an interval), and the share of the
    parent's training rows. ``prior`` is the nearest node above whose edge asks the same feature (-1:
    none); ``share`` holds the product along such nodes. ``values`` are a leaf's, 0 elsewhere.
    """

    parent: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kind: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    values: np.ndarray
    levels: list[tuple[int, int]]
    categories: np.ndarray


def flat_tree(nodes: dict[int, dict], weight: float, by_class: bool) -> Tree:
    """A tree of Spark's node table (rows by id), its values times a weight.

    A classification forest averages the class shares of its leaves; other trees add values.
    """

    def values(node: dict) -> list[float]:
        if not by_class:
            return [weight * float(node["prediction"])]
        counts = [float(n) for n in node["impurityStats"]]
        return [weight * n / sum(counts) for n in counts]

    zero = [0.0] * len(values(nodes[0]))
    rows = [(-1, -1, -math.inf, math.inf, -1, 1.0, -1)]
    leaf, sets, levels = [], [], [(0, 1)]
    level = [(0, 0, {})]  # node of the table, its place, the nearest edges by feature
    while level:
        below = []
        for number, place, nearest in level:
            node = nodes[number]
            children = int(node["leftChild"]), int(node["rightChild"])
            leaf.append(values(node) if children[0] < 0 else zero)
            if children[0] < 0:
                continue
            split = node["split"]
            split = split.asDict() if hasattr(split, "asDict") else dict(split)
            feature, arity = int(split["featureIndex"]), int(split["numCategories"])
            asked = [float(v) for v in split["leftCategoriesOrThreshold"]]
            prior = nearest.get(feature, -1)
            for child, left in zip(children, (True, False), strict=True):
                share = float(nodes[child]["rawCount"]) / float(node["rawCount"])
                share *= rows[prior][5] if prior >= 0 else 1.0
                low, high, kind = -math.inf, math.inf, -1
                if arity < 0:
                    low, high = (low, asked[0]) if left else (asked[0], high)
                else:
                    kind = len(sets)
                    sets.append([(code in asked) == left for code in range(arity)])
                rows.append((place, feature, low, high, kind, share, prior))
                below.append((child, len(rows) - 1, {**nearest, feature: len(rows) - 1}))
        if below:
            levels.append((len(rows) - len(below), len(rows)))
        level = below
    arity = max(map(len, sets), default=0)
    table = np.array([x + [False] * (arity - len(x)) for x in sets], dtype=bool).reshape(len(sets), arity)
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    return Tree(*columns, np.array(leaf), levels, table)


def model_trees(spark: SparkSession, model) -> list[Tree]:
    """Weighted trees of a fitted ensemble, read from its saved node table.

    A model is bounded by its own settings (trees times nodes), never by the data.
    """

    path = fresh_path(spark, "tree-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").toPandas()
    weights = [float(w) for w in model.treeWeights] if hasattr(model, "treeWeights") else None
    if "nodeData" in nodes:
        parts = nodes["nodeData"].apply(lambda r: r.asDict() if hasattr(r, "asDict") else dict(r))
        table = pd.DataFrame(list(parts))
        table["tree"] = nodes["treeID"] if "treeID" in nodes else 0
    else:
        table = nodes.assign(tree=0)
    averaged = type(model).__name__.startswith("RandomForest")
    by_class = type(model).__name__ == "RandomForestClassificationModel"
    groups = list(table.groupby("tree", sort=True))
    return [
        flat_tree({int(r["id"]): r for r in group.to_dict("records")},
                  1.0 / len(groups) if averaged else (weights[place] if weights else 1.0), by_class)
        for place, (_, group) in enumerate(groups)]


def base_values(trees: Sequence[Tree]) -> np.ndarray:
    """What the ensemble expects, by class, of a row of which nothing is known."""

    total = np.zeros(trees[0].values.shape[1])
    for tree in trees:
        reach = np.ones(len(tree.parent))
        for start, stop in tree.levels[1:]:
            here = slice(start, stop)
            prior = tree.prior[here]
            own = tree.share[here] / np.where(prior >= 0, tree.share[prior], 1.0)
            reach[here] = reach[tree.parent[here]] * own
        total += reach @ tree.values
    return total


#: Numbers that an array over nodes, points and rows holds at most.
HELD = 1 << 21


def tree_attributions(x: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    """Shapley values of a tree ensemble for a matrix of rows (path-dependent expectation), as an
    array of classes by rows by features.

    A leaf's value is a game among the features on its path: a feature in the coalition keeps the
    leaf if the row meets its conditions, one outside keeps it with its training share. If every
    feature joins with a chance t, a path keeps ``share + t * (meets - share)`` for each of its
    features; a feature's Shapley value is the integral over t of the product of the others times
    ``meets - share``. The integrand is a polynomial, so a few Gauss points give it exactly. Products are
    built level by level towards the leaves and summed level by level back, in time proportional to
    the nodes; where a feature is asked again, the later factor replaces the earlier one.
    """

    out = np.zeros((trees[0].values.shape[1], *x.shape))
    for tree in trees:
        if len(tree.levels) < 2:
            continue
        points, weights = np.polynomial.legendre.leggauss(len(tree.levels) // 2)
        points, weights = (points + 1) / 2, weights / 2
        rows = max(1, HELD // (len(tree.parent) * len(points)))
        for start in range(0, len(x), rows):
            part = slice(start, start + rows)
            out[:, part] += _one_tree(x[part], tree, points, weights)
    return out


def _one_tree(x: np.ndarray, tree: Tree, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n, t = len(tree.parent), points[None, :, None]
    meets = np.ones((n, len(x)), dtype=bool)
    kept = np.ones((n, len(points), len(x)))  # products along the path, of the latest factors only
    pull = np.zeros((n, len(points), len(x)))  # of the latest factor: (meets - share) / factor

    for start, stop in tree.levels[1:]:
        here = slice(start, stop)
        value, prior, kind = x[:, tree.feature[here]].T, tree.prior[here], tree.kind[here]
        asked = (value > tree.low[here, None]) & (value <= tree.high[here, None])
        coded = np.flatnonzero(kind >= 0)
        if len(coded):
            codes = value[coded].astype(int)
            known = (codes >= 0) & (codes < tree.categories.shape[1])
            asked[coded] = known & tree.categories[
                kind[coded, None], np.where(known, codes, 0)]
        again = prior >= 0
        meets[here] = asked & (meets[prior] | ~again[:, None])
        gap = meets[here] - tree.share[here, None]
        factor = tree.share[here, None, None] + t * gap[:, None]
        kept[here] = kept[tree.parent[here]] * factor
        if again.any():
            before = prior[again]
            kept[start + np.flatnonzero(again)] /= tree.share[before, None, None] + t * (
                meets[before] - tree.share[before, None])[:, None]
        pull[here] = gap[:, None] / factor

    out = np.zeros((tree.values.shape[1], *x.shape))
    features, place = np.unique(tree.feature[1:], return_inverse=True)
    change = pull[1:] - np.where((tree.prior[1:] >= 0)[:, None, None], pull[tree.prior[1:]], 0.0)
    change *= weights[None, :, None]
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(len(features)))
    for k in range(len(out)):
        total = kept * tree.values[:, k, None, None]
        for start, stop in reversed(tree.levels[1:]):  # siblings are side by side
            total[tree.parent[start:stop:2]] += total[start:stop:2] + total[start + 1:stop:2]
        share = np.einsum("npr,npr->nr", change, total[1:])
        out[k][:, features] = np.add.reduceat(share[order], first, axis=0).T
    return out


def tree_values(prepared: DataFrame, model, id_columns: Sequence[str],
                trees: Sequence[Tree] | None = None) -> DataFrame:
    """Tree attributions, one row per explained row, class and slot; the rows are dealt to as many
    tasks as there are cores, and the trees are broadcast."""

    spark = prepared.sparkSession
    shared = spark.sparkContext.broadcast(trees or model_trees(spark, model))
    # the function travels whole, so that workers need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = prepared.select(*id_columns, vector_to_array("features").alias("_x")).repartition(
        spark.sparkContext.defaultParallelism)
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
                    if f.name != "_x")

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["_x"].to_list(), dtype=float)
            for k, values in enumerate(tree_attributions(x, shared.value) if len(x) else ()):
                yield batch.drop(columns="_x").assign(class_index=k, _x=list(x), _v=list(values))

    arrays = rows.mapInPandas(attribute, f"{ids}, class_index int, _x array<double>, _v array<double>")
    return arrays.select(
        *id_columns, "class_index", F.posexplode(F.arrays_zip("_x", "_v"))).select(
        *id_columns, "class_index", F.col("pos").alias("slot_index"),
        F.col("col._x").alias("input"), F.col("col._v").alias("attribution"))


def mean_absolute(values: DataFrame) -> DataFrame:
    """Mean absolute attribution per slot, over rows (and over classes, if there are any)."""

    return values.groupBy("slot_index").agg(F.avg(F.abs("attribution")).alias("mean_abs_shap"))


def explain(
    model: PipelineModel, name: str, background: DataFrame, explained: DataFrame,
    id_columns: Sequence[str], *, split: str = "test", max_rows: int = 1000,
    background_rows: int = 500, seed: int = 42,
) -> Attributions:
    """Attributions of a fitted pipeline on a bounded sample, per slot and per source column."""

    if name not in (*LINEAR, *TREES):
        raise ValueError(f"There is no attribution for {name!r}.")
    facts = {"model_name": name, "explained_split": split, "max_rows": max_rows,
             "background_rows": background_rows}
    learner = model.stages[-1]
    sample = _prepared(model, sample_rows(explained, id_columns, max_rows, seed=seed + 1))
    center = _prepared(model, sample_rows(background, id_columns, background_rows, seed=seed))
    if name in LINEAR:
        vectors = [learner.coefficients.toArray()] if getattr(learner, "numClasses", 2) == 2 \
            else list(learner.coefficientMatrix.toArray())
        values = linear_values(sample, vectors, center, id_columns)
    else:
        trees = model_trees(explained.sparkSession, learner)
        values = tree_values(sample, learner, id_columns, trees)
        facts["base_values"] = base_values(trees).tolist()
    slots = _slot_table(sample)
    by_slot = mean_absolute(values).join(slots, "slot_index").select(
        "feature", "source_feature", "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")
    by_source = by_slot.groupBy(F.col("source_feature").alias("feature")).agg(
        F.sum("mean_abs_shap").alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
    return Attributions(values.join(slots, "slot_index"), by_slot, by_source, facts)
