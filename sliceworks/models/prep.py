"""Train-only preparation as pipeline stages.

``Prep`` is an estimator: inside a pipeline, and so inside every fold of a cross-validation, its
statistics come from the rows it is fitted on. What it fits to is made of Spark's own JVM
transformers, so fitted pipelines save and load without Python classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.checks import fresh_name
from sliceworks.operators.categories import few_rows
from sliceworks.operators.ordering import exact_quantiles
from sliceworks.operators.profile import normalized


def feature_types(df: DataFrame, features: Sequence[str], bool_is_category: bool = False
                  ) -> tuple[list[str], list[str]]:
    """Category columns and number columns, in feature order."""

    category_types = (T.StringType, T.BooleanType) if bool_is_category else (T.StringType,)
    categories = [c for c in features if isinstance(df.schema[c].dataType, category_types)]
    return categories, [c for c in features if c not in categories]


def fit_categories(train: DataFrame, columns: Sequence[str], parts: Sequence[Column]) -> list[dict[str, dict[str, int]]]:
    """For each part of the rows, how many hold every category of each column, categories in alphabetical order.

    Values are counted per column before anything is fetched; the categories become named slots of
    a vector, so the driver needs their list, and too many of them are an error.
    """

    found: list[dict[str, dict[str, int]]] = [{c: {} for c in columns} for _ in parts]
    if not columns:
        return found
    flags = [fresh_name(train, f"part{k}") for k in range(len(parts))]
    counts = (
        train.select(*[p.alias(f) for p, f in zip(parts, flags, strict=True)],
                     *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot(flags, list(columns), "column", "value").filter("value is not null")
        .groupBy("column", "value").agg(*[F.count_if(f).alias(f"n{k}") for k, f in enumerate(flags)])
        .filter(F.greatest(F.lit(0), *[f"n{k}" for k in range(len(parts))]) > 0)
    )
    for row in sorted(few_rows(counts, "categories"), key=lambda r: (r["column"], r["value"])):
        for k, part in enumerate(found):
            if row[f"n{k}"]:
                part[row["column"]][row["value"]] = row[f"n{k}"]
    return found


def mode(categories: Mapping[str, int]) -> str | None:
    """The most frequent category, ties to the smallest."""

    return min(categories, key=lambda c: (-categories[c], c)) if categories else None


def fit_medians(train: DataFrame, columns: Sequence[str], parts: Sequence[Column]) -> list[dict[str, float | None]]:
    """The exact median of each column in each part of the rows."""

    numbers = train.select(*[F.when(p, normalized(train, c).cast("double")).alias(f"{k}_{i}")
                             for k, p in enumerate(parts) for i, c in enumerate(columns)])
    medians = exact_quantiles(numbers, {c: (0.5,) for c in numbers.columns})
    return [{c: medians[f"{k}_{i}"][0] for i, c in enumerate(columns)} for k in range(len(parts))]


def fit_scales(train: DataFrame, fills: Sequence[dict[str, float]], parts: Sequence[Column]
               ) -> list[dict[str, tuple[float, float]]]:
    """Mean and population deviation of each column in each part after filling; deviation 1 if there is none."""

    if not any(fills):
        return [{} for _ in parts]
    filled = {(k, c): F.when(p, F.coalesce(normalized(train, c).cast("double"), F.lit(v)))
              for k, p in enumerate(parts) for c, v in fills[k].items()}
    row = train.agg(*[m.alias(f"{i}_{n}") for i, v in enumerate(filled.values())
                      for n, m in (("m", F.avg(v)), ("s", F.stddev_pop(v)))]).first()
    found: list[dict[str, tuple[float, float]]] = [{} for _ in parts]
    for i, (k, c) in enumerate(filled):
        found[k][c] = (row[f"{i}_m"], row[f"{i}_s"] or 1.0)
    return found


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _text(value: str) -> str:
    # the words are plain category names; both quoting characters are escaped
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class Prep(Estimator, HasOutputCol):
    """One-hot encoding of category columns beside number columns, as one vector.

    ``impute`` fills categories with the mode and numbers with the median; ``standardise`` centres
    and scales the numbers. Unknown categories give all zeros. Columns without any training value
    are dropped when imputing.
    """

    features = Param(Params._dummy(), "features", "input columns", TypeConverters.toListString)
    impute = Param(Params._dummy(), "impute", "fill missing values", TypeConverters.toBoolean)
    standardise = Param(Params._dummy(), "standardise", "centre and scale", TypeConverters.toBoolean)
    boolAsCategory = Param(Params._dummy(), "boolAsCategory", "one-hot encode booleans",
                           TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, features=None, impute=False, standardise=False, boolAsCategory=False,
                 outputCol="features"):
        super().__init__()
        self._setDefault(impute=False, standardise=False, boolAsCategory=False,
                         outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return self.fit_parts(dataset, [F.lit(True)])[0]

    def fit_parts(self, dataset: DataFrame, parts: Sequence[Column]) -> list[PipelineModel]:
        """The preparation of each part of the rows (a condition), with as many passes as for one of them."""

        impute, standardise = self.getOrDefault("impute"), self.getOrDefault("standardise")
        categories, numbers = feature_types(
            dataset, self.getOrDefault("features"), self.getOrDefault("boolAsCategory"))
        found = fit_categories(dataset, categories, parts)
        medians = fit_medians(dataset, numbers, parts) if impute else [{} for _ in parts]
        used = [[c for c in numbers if not impute or medians[k][c] is not None] for k in range(len(parts))]
        scales = fit_scales(dataset, [{c: medians[k].get(c, 0.0) for c in used[k]} for k in range(len(parts))],
                            parts) if standardise else [{} for _ in parts]
        return [self._prepared(dataset.filter(part), found[k], used[k], medians[k], scales[k])
                for k, part in enumerate(parts)]

    def _prepared(self, dataset: DataFrame, found: Mapping[str, Mapping[str, int]], numbers: Sequence[str],
                  medians: Mapping[str, float], scales: Mapping[str, tuple[float, float]]) -> PipelineModel:
        impute, standardise = self.getOrDefault("impute"), self.getOrDefault("standardise")
        modes = {c: mode(found[c]) for c in found}
        categories = [c for c in found if modes[c] is not None]
        columns = []
        for c in categories:
            source = f"CAST({_quoted(c)} AS STRING)"
            if impute:
                source = f"COALESCE({source}, {_text(modes[c])})"
            columns.append(f"{source} AS {_quoted('category ' + c)}")
        for c in numbers:
            value = f"NANVL(CAST({_quoted(c)} AS DOUBLE), NULL)"
            if impute:
                value = f"COALESCE({value}, {_double(medians[c])})"
            if standardise:
                mean, deviation = scales[c]
                value = f"({value} - {_double(mean)}) / {_double(deviation)}"
            columns.append(f"{value} AS {_quoted(c + ' value')}")
        stages = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
        encoded = list(map(_slot, categories))
        if categories:
            # one stage per column: the constructor for several pads shorter label lists with null
            stages += [StringIndexerModel.from_labels(
                list(found[c]), inputCol=f"category {c}", outputCol=f"code {c}",
                handleInvalid="keep") for c in categories]
            # "keep" makes unknown the last code and dropLast removes exactly that code's slot
            encoder = OneHotEncoder(
                inputCols=[f"code {c}" for c in categories], outputCols=encoded, dropLast=True,
                handleInvalid="error",
            ).fit(PipelineModel(list(stages)).transform(dataset))
            stages.append(encoder)
        # missing numbers without imputing: NaN, which tree learners reject and the caller must fill
        stages.append(VectorAssembler(
            inputCols=encoded + [f"{c} value" for c in numbers],
            outputCol=self.getOrDefault("outputCol"), handleInvalid="keep"))
        return PipelineModel(stages)


def _slot(column: str) -> str:
    return f"{column} is"


def classification_prep(features: Sequence[str]) -> Prep:
    """One-hot categories, numbers as they are, nothing filled."""

    return Prep(features=list(features))


def regression_prep(features: Sequence[str]) -> Prep:
    """Mode and median filling, no scaling."""

    return Prep(features=list(features), impute=True)


def release_prep(features: Sequence[str]) -> Prep:
    """Mode and median filling, then centred and scaled numbers; booleans are categories."""

    return Prep(features=list(features), impute=True, standardise=True, boolAsCategory=True)


def vector_names(transformed: DataFrame, vector: str = "features") -> list[tuple[str, str]]:
    """``(slot name, source column)`` of a prepared vector, from its metadata."""

    attributes = transformed.schema[vector].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    names = []
    for _, name in slots:
        if name.endswith(" value"):
            source = name.removesuffix(" value")
            names.append((source, source))
        else:
            source, _, category = name.partition(" is_")
            names.append((f"{source}_{category}", source))
    return names
