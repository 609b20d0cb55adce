"""Readers and writers: CSV and Parquet tables, packaged releases, prediction tables, models."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceworks.checks import require_columns
from sliceworks.functions.numbers import blank_markers_to_null
from sliceworks.operators.features import nested_feature_tables
from sliceworks.operators.ordering import if_small
from sliceworks.operators.profile import feature_report
from sliceworks.operators.rules import DETAILS, Prepared, issue_ranges, validation_summary
from sliceworks.operators.splits import SPLITS, label_splits
from sliceworks.operators.subsets import drop_columns
from sliceworks.session import fresh_path
from sliceworks.sources.records import has_quoted_breaks, read_lines, records

# The raw log's columns and their types before coercion.
RAW_LOG_SCHEMA = T.StructType([
    T.StructField("circuit_id", T.StringType()), T.StructField("qubit_count", T.StringType()),
    T.StructField("gate_depth", T.StringType()), T.StructField("gate_types", T.StringType()),
    T.StructField("error_rate_gate", T.StringType()), T.StructField("t1_time", T.StringType()),
    T.StructField("t2_time", T.StringType()), T.StructField("readout_error", T.StringType()),
    T.StructField("shots", T.StringType()), T.StructField("bitstring", T.StringType()),
    T.StructField("ideal_bitstring", T.StringType()), T.StructField("fidelity", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("device_type", T.StringType()),
    T.StructField("error_type", T.StringType()),
])


def infer_format(path: str) -> str:
    """``csv`` or ``parquet`` by the extension."""

    lowered = path.rstrip("/").lower()
    for extension, name in ((".csv", "csv"), (".parquet", "parquet"), (".pq", "parquet")):
        if lowered.endswith(extension):
            return name
    raise ValueError(f"Cannot infer a table format from {path!r}.")


# One character that starts an escape, and what stands for it, a line feed and a carriage return.
MARK = "\x1a"
MARKED = ((MARK, MARK + "0"), ("\n", MARK + "1"), ("\r", MARK + "2"))


def _one_line_each(spark: SparkSession, path: str) -> tuple[str, list[str]] | None:
    """Where quoted fields hold line breaks: a copy in the shared folder with each record on one line,
    breaks marked, and the column names. Null where there are none."""

    lines = read_lines(spark, path)
    if lines is None or not has_quoted_breaks(lines):
        return None
    found = records(lines)
    first = found.filter("block = 0 AND at = 0").orderBy("file_path").select("record").first()
    names = [name or f"_c{k}" for k, name in enumerate(next(csv.reader([first["record"]])))]
    lowered = [name.lower() for name in names]
    names = [f"{n}{k}" if lowered.count(n.lower()) > 1 else n for k, n in enumerate(names)]
    line = F.col("record")
    for plain, marked in MARKED:
        line = F.replace(line, F.lit(plain), F.lit(marked))
    folder = fresh_path(spark, "records")
    found.filter("NOT (block = 0 AND at = 0)").select(line.alias("value")).write.text(folder)
    return folder, names


def _with_breaks(value: Column) -> Column:
    for plain, marked in reversed(MARKED):
        value = F.replace(value, F.lit(marked), F.lit(plain))
    return value


def read_table(
    spark: SparkSession, path: str, *, file_format: str = "auto",
    string_columns: Sequence[str] = (), schema: T.StructType | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Read CSV or Parquet. CSV types come from the schema; without one Spark infers them,
    except that ``string_columns`` stay text. Missing markers in text become null.

    Quoted line breaks stay inside their field, and files are split all the same: where there are any,
    a copy with one record on each line is read instead.
    """

    chosen = infer_format(path) if file_format == "auto" else file_format
    try:
        if chosen == "parquet":
            table = spark.read.parquet(path)
        elif chosen == "csv":
            copy = _one_line_each(spark, path)
            source, names = copy or (path, None)
            reader = spark.read.options(header=copy is None, nullValue="", escape='"')
            if schema is not None or string_columns:
                # the file's header decides the order of the columns
                names = names or spark.read.csv(path, header=True, escape='"').columns
                if schema is not None:
                    by_name = {f.name: f for f in schema}
                else:
                    inferred = reader.csv(source, inferSchema=True).schema
                    by_name = {n: T.StructField(n, T.StringType() if n in string_columns else f.dataType)
                               for n, f in zip(names, inferred, strict=True)}
                fields = [by_name.get(n, T.StructField(n, T.StringType())) for n in names]
                table = reader.schema(T.StructType(fields)).csv(source)
            else:
                table = reader.csv(source, inferSchema=True)
                table = table.toDF(*names) if names else table
            texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]
            value = (lambda c: _with_breaks(F.col(c))) if copy else F.col
            table = table.withColumns({c: blank_markers_to_null(value(c)) for c in texts})
        else:
            raise ValueError(f"Unsupported file format: {chosen!r}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"No table at {path!r}.") from error
        raise
    require_columns(table, required)
    return table


def read_raw_log(spark: SparkSession, path: str, *, file_format: str = "auto",
                 schema: T.StructType = RAW_LOG_SCHEMA) -> DataFrame:
    """Read the raw log, every field as text: coercion decides what is a number."""

    return read_table(spark, path, file_format=file_format, schema=schema,
                      required=schema.fieldNames())


def read_release(
    spark: SparkSession, paths: Mapping[str, str], *, payload: Sequence[str] = ()
) -> DataFrame:
    """Three split files as one table with ``split_name``; payload columns are never read."""

    absent = [s for s in SPLITS if s not in paths]
    if absent:
        raise ValueError(f"No path for the splits: {absent}")
    frames = {s: drop_columns(read_table(spark, paths[s], file_format="parquet"), payload)
              for s in SPLITS}
    return label_splits(frames)


def read_release_folder(spark: SparkSession, folder: str, *, payload: Sequence[str] = ()) -> DataFrame:
    """The same for a folder holding ``train``, ``validation`` and ``test`` Parquet."""

    return read_release(spark, {s: f"{folder}/{s}.parquet" for s in SPLITS}, payload=payload)


def write_prepared(
    prepared: Prepared, *, cleaned_path: str, invalid_path: str, report_path: str,
    source_columns: Sequence[str],
) -> None:
    """Cleaned rows as Parquet, quarantined rows as CSV (only if any), the report as JSON."""

    as_json = F.to_json(DETAILS)
    prepared.valid.withColumn(DETAILS, as_json).write.mode("overwrite").parquet(cleaned_path)
    invalid = prepared.invalid.withColumn(DETAILS, as_json)
    if not invalid.isEmpty():
        invalid.write.mode("overwrite").csv(invalid_path, header=True, escape='"')
    summary = validation_summary(prepared, source_columns)
    summary.write.mode("overwrite").json(f"{report_path}/summary")
    issue_ranges(prepared.checked).write.mode("overwrite").json(f"{report_path}/issues")


def write_feature_tables(df: DataFrame, folder: str, **settings) -> dict[str, DataFrame]:
    """Write the three nested feature tables and their report; return them read back."""

    tables = nested_feature_tables(df, **settings)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    back = {name: df.sparkSession.read.parquet(f"{folder}/{name}") for name in tables}
    report = feature_report(back, [settings["id_column"], settings["label_column"]])
    report.write.mode("overwrite").json(f"{folder}/feature_report")
    return back


RUN_FOLDERS = ("ablation_name", "model_name", "split_name")


def write_predictions(df: DataFrame, folder: str, mode: str = "append", rows_per_file: int = 200_000) -> None:
    """Prediction rows of all runs, one folder per regime, model and split.

    A folder gets as many files as its rows fill, and each file has a task of its own, whose memory does
    not grow with the table: rows are dealt to the files of their run by a hash.
    """

    files = df.groupBy(*RUN_FOLDERS).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_{c}") for c in RUN_FOLDERS],
        F.ceil(F.col("_n") / rows_per_file).cast("int").alias("_files"))
    # one row per run and split
    before = F.sum("_files").over(Window.orderBy(*[f"_{c}" for c in RUN_FOLDERS])) - F.col("_files")
    counted = if_small(files.withColumn("_first", before))
    total = max(1, counted.agg(F.sum("_files")).first()[0] or 1)
    plain = [c.name for c in df.schema if not isinstance(c.dataType, T.MapType)]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RUN_FOLDERS])
    salted = df.join(counted, same).withColumn(
        "_file", (F.col("_first") + F.pmod(F.xxhash64(*plain), F.col("_files"))).cast("int"))
    salted.repartitionById(total, "_file").select(*df.columns).write.mode(mode).partitionBy(
        *RUN_FOLDERS).parquet(folder)


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Saved predictions; a filter on the run keys prunes folders."""

    return spark.read.parquet(folder)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""

    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""

    return PipelineModel.load(path)
