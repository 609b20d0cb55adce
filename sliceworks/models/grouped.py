"""Linear models for every subgroup at once, from sums by group instead of a fit for each.

Ridge needs one aggregation: the products of the columns, summed by group. Logistic regression takes Newton
steps: a pass adds up gradient and curvature of all groups that have not settled, each task holding one
small sum per group it meets; then each group's step is solved where its sums lie. The number of jobs
depends on the slowest group's steps, not on the number of groups, and a group with a third of all rows
is summed by all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceworks.operators.ordering import if_small
from sliceworks.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups whose sums a task holds before it sends them on, most Newton steps, and the step that counts as none.
HELD, STEPS, SETTLED = 1000, 60, 1e-9


def grouped_ridge(df: DataFrame, group: str, features: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """``intercept`` and ``coefficients`` of a ridge regression (penalty ``alpha`` on the sum of squares) of each
    group, rows without a group being one. Rows with a missing value are left out."""

    columns = [F.col(c).cast("double") for c in [*features, target]]
    rows = df.select(F.col(group), *[c.alias(f"_{k}") for k, c in enumerate(columns)]).dropna(
        subset=[f"_{k}" for k in range(len(columns))])
    # around the mean of all rows, so that large offsets do not swallow the differences
    means = rows.agg(*[F.avg(f"_{k}") for k in range(len(columns))]).first()
    centered = [F.col(f"_{k}") - F.lit(float(m or 0.0)) for k, m in enumerate(means)]
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d + 1)]
    sums = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[F.sum(c) for c in centered]).alias("s"),
        F.array(*[F.sum(centered[i] * centered[j]) for i, j in pairs]).alias("p"))
    offset = np.array([float(m or 0.0) for m in means])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, s, p in zip(*(batch.column(c).to_pylist() for c in ("rows", "s", "p")), strict=True):
                mean, gram, cross = np.array(s) / n, np.zeros((d, d)), np.zeros(d)
                for (i, j), x in zip(pairs, p, strict=True):
                    x -= n * mean[i] * mean[j]
                    if j == d:
                        cross[i] = x
                    else:
                        gram[i, j] = gram[j, i] = x
                w = np.linalg.lstsq(gram + alpha * np.eye(d), cross, rcond=None)[0]
                out.append((float(mean[d] + offset[d] - w @ (mean[:d] + offset[:d])), w.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in out], pa.float64()),
                 pa.array([w for _, w in out], pa.list_(pa.float64()))],
                names=[group, "rows", "intercept", "coefficients"])

    kind = df.schema[group].dataType.simpleString()
    return sums.mapInArrow(solve, f"`{group}` {kind}, rows long, intercept double, coefficients array<double>")


def logits(x: np.ndarray, theta: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Class probabilities of rows (with a leading 1) by their own weights, over the classes present."""

    z = np.einsum("nd,nkd->nk", x, theta)
    z = np.where(present, z, -np.inf)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def grouped_logistic(df: DataFrame, group: str, classes: int, *, c: float = 1.0, balanced: bool = False,
                     vector: str = "features", label: str = "label_code") -> DataFrame:
    """``theta`` (by class: intercept, then weights) and ``present`` classes of each group's logistic regression.

    The loss and penalty are those of one fit on the group's rows: inverse penalty ``c`` on the summed
    loss, ``balanced`` weights by the group's class counts. Two classes are fitted as one
    against the other, more as a softmax. Classes a group does not have get no probability.
    """

    rows = df.filter(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.col(label).cast("int").alias("y"), vector_to_array(vector).alias("x"))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(classes)], F.max(F.size("x")).alias("d"))
    by_class = F.array(*[F.col(f"n{k}") for k in range(classes)])
    width = F.col("d") + 1
    state = written(counts.select(
        "g", "n", by_class.alias("counts"), F.array_repeat(F.lit(0.0), classes * width).alias("theta"),
        F.array_repeat(F.lit(0.0), classes * width).alias("step"), F.lit(float("inf")).alias("loss"),
        F.lit(False).alias("done")), "newton")
    kind = df.schema[group].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), keys), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                names=["g", "sums"])

        for batch in batches:
            keys = batch.schema.field("g").type
            names = batch.column("g").dictionary_encode()
            index = names.indices.to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            x = np.concatenate([np.ones((len(y), 1)), x], 1)
            theta = batch.column("theta").flatten().to_numpy().reshape(len(y), classes, x.shape[1])
            counts = batch.column("counts").flatten().to_numpy().reshape(len(y), classes)
            present = counts > 0
            weight = np.ones(len(y))
            if balanced:
                weight = counts.sum(1) / (present.sum(1) * counts[np.arange(len(y)), y])
            p = logits(x, theta, present)
            residual = p.copy()
            residual[np.arange(len(y)), y] -= 1.0
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = index == k
                xs, ps, ws = x[own], p[own], weight[own]
                loss = -(ws * np.log(np.maximum(ps[np.arange(len(xs)), y[own]], 1e-300))).sum()
                gradient = (ws[:, None] * residual[own]).T @ xs
                curve = np.einsum("na,nb->nab", -ps, ps)
                curve[:, np.arange(classes), np.arange(classes)] += ps
                hessian = np.einsum("n,nab,ni,nj->aibj", ws, curve, xs, xs, optimize=True)
                total = np.concatenate([[loss, ws.sum()], gradient.ravel(), hessian.ravel()])
                held[name] = held[name] + total if name in held else total
            if len(held) >= HELD:
                yield send()
                held.clear()
        if held:
            yield send()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                theta, last = np.array(row["theta"]), np.array(row["step"])
                present = np.array(row["counts"]) > 0
                if present.sum() < 2:
                    out.append((*_kept(row), theta.tolist(), last.tolist(), 0.0, True))
                    continue
                d = len(theta) // classes
                sums = np.array(row["sums"])
                # on the mean loss; two classes share one weight vector, so each carries half of it
                penalty = 1.0 / (c * row["n"]) * (2.0 if present.sum() == 2 else 1.0)
                w = theta.reshape(classes, d)
                free = np.tile(np.append(0.0, np.ones(d - 1)), classes)
                loss = sums[0] / sums[1] + penalty / 2 * (w[:, 1:] ** 2).sum()
                if loss > row["loss"] + 1e-12 * abs(row["loss"]):  # too far: half of the last step back
                    out.append((*_kept(row), (theta - last / 2).tolist(), (last / 2).tolist(), row["loss"],
                                bool(np.abs(last).max() < SETTLED)))
                    continue
                gradient = sums[2:2 + len(theta)] / sums[1] + penalty * free * theta
                hessian = sums[2 + len(theta):].reshape(len(theta), -1) / sums[1] + penalty * np.diag(free)
                step = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
                out.append((*_kept(row), (theta + step).tolist(), step.tolist(), float(loss),
                            bool(np.abs(step).max() < SETTLED)))
            names = ["g", "n", "counts", "theta", "step", "loss", "done"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, batch.schema.field(name).type) for name, column in zip(
                    names, zip(*out, strict=True), strict=True)], names=names) if out else batch.select(names)

    def _kept(row: dict) -> tuple:
        return row["g"], row["n"], row["counts"]

    schema = (f"g {kind}, n long, counts array<long>, theta array<double>, step array<double>, loss double, "
              "done boolean")
    for _ in range(STEPS):
        open_groups = state.filter("not done")
        if open_groups.isEmpty():
            break
        sums = rows.join(if_small(open_groups.select("g", "counts", "theta")), "g").mapInArrow(
            add_up, f"g {kind}, sums array<double>").groupBy("g").agg(
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        moved = open_groups.join(sums, "g").mapInArrow(move, schema)
        state = written(moved.unionByName(state.filter("done")), "newton")
    return state.select(F.col("g").alias(group), "theta", F.transform("counts", lambda n: n > 0).alias("present"))


def grouped_probabilities(df: DataFrame, models: DataFrame, group: str, vector: str = "features") -> DataFrame:
    """Rows with the ``scores`` of their group's classes; groups without a model have none."""

    key = "_group_of_model"
    theta = if_small(models.withColumnRenamed(group, key))
    joined = df.join(theta, F.col(group) == F.col(key), "left").drop(key)
    x = F.concat(F.array(F.lit(1.0)), vector_to_array(vector))
    n, d = F.size("present"), F.size("_x")
    dot = lambda k: F.aggregate(F.zip_with(F.slice("theta", k * d + 1, d), "_x", lambda a, b: a * b),
                                F.lit(0.0), lambda a, b: a + b)
    z = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(F.get("present", k), dot(k)))
    powers = F.transform("_z", lambda v: F.coalesce(F.exp(v - F.array_max("_z")), F.lit(0.0)))
    total = F.aggregate("_p", F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn("_x", x).withColumn("_z", F.when(F.col("theta").isNotNull(), z)).withColumn(
        "_p", powers).withColumn("scores", F.transform("_p", lambda v: v / total)).drop(
        "_x", "_z", "_p", "theta", "present")
