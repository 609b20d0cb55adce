"""Saved runs: result tables in run folders, read as cells by column name.

Run folders come in several layouts with different columns. The header of each file is split off and
every record, line breaks in its quoted cells included, becomes a map from column to text, so one scan
serves all layouts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceworks.sources.records import fields, read_lines, records

def read_texts(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Whole files matching a glob, with their path; null when there are none."""

    try:
        files = spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return files.select(F.col("_metadata.file_path").alias("file_path"), "value")


def _run_parts(path: Column, file_name: str) -> dict[str, Column]:
    pattern = rf"^(.*/)?([^/]+)/([^/]+)/{file_name.replace('.', '[.]')}(/.*)?$"
    return {
        "run_root": F.regexp_extract(path, pattern, 2),
        "run_name": F.regexp_extract(path, pattern, 3),
    }


def column_names(header: Column) -> Column:
    """A header's names; a repeated one gets its number (``x``, ``x.1``), one without text is null."""

    earlier = lambda names, name, i: F.size(F.filter(F.slice(names, 1, i), lambda n: n == name))
    names = fields(header)
    return F.transform(names, lambda name, i: F.when(earlier(names, name, i) > 0, F.concat(
        name, F.lit("."), earlier(names, name, i).cast("string"))).otherwise(name))


def scan_tables(spark: SparkSession, root: str, file_name: str) -> DataFrame | None:
    """Records of ``root/<run>/<file_name>``: run_root, run_name, line number, cells by column.

    Blank records are left out. A column without a name keeps its place while names and cells are
    matched, then goes; of a name that still repeats, the last cell counts.
    """

    lines = read_lines(spark, f"{root}/*/{file_name}")
    if lines is None:
        return None
    parts = _run_parts(F.col("file_path"), file_name)
    in_file = Window.partitionBy("file_path").orderBy("block", "at")
    placed = records(lines).filter(F.trim("record") != "").withColumn("place", F.row_number().over(in_file))
    heads = placed.filter("place = 1").select("file_path", column_names(F.col("record")).alias("_columns"))
    named = placed.filter("place > 1").join(heads, "file_path").withColumn("_pairs", F.filter(
        F.arrays_zip(F.col("_columns").alias("name"), fields(F.col("record")).alias("cell")),
        lambda pair: pair["name"].isNotNull()))
    distinct = F.filter("_pairs", lambda pair, i: ~F.exists(
        F.slice("_pairs", i + 2, F.size("_pairs")), lambda later: later["name"] == pair["name"]))
    return named.select(
        parts["run_root"].alias("run_root"), parts["run_name"].alias("run_name"),
        (F.col("place") - 2).alias("line_number"), F.map_from_entries(distinct).alias("cells"))


def scan_json(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame | None:
    """Documents ``root/<run>/<file_name>`` parsed by a schema: run_name and one struct."""

    files = read_texts(spark, f"{root}/*/{file_name}")
    if files is None:
        return None
    parts = _run_parts(F.col("file_path"), file_name)
    return files.select(
        parts["run_root"].alias("run_root"), parts["run_name"].alias("run_name"),
        F.from_json("value", schema).alias("document"),
    )


def write_result_table(df: DataFrame, run_folder: str, file_name: str = "model_comparison.csv") -> None:
    """A small result table as CSV inside a run folder."""

    df.coalesce(1).write.mode("overwrite").csv(f"{run_folder}/{file_name}", header=True, escape='"')


def write_run_config(spark: SparkSession, run_folder: str, settings: dict[str, str]) -> None:
    """The settings a run was made with, as one JSON document."""

    columns = ", ".join(f"{name} string" for name in settings)
    spark.createDataFrame([tuple(settings.values())], columns).coalesce(1).write.mode(
        "overwrite").json(f"{run_folder}/run_config.json")


def number(name: str, *others: str) -> Column:
    """The first of several columns a line has, as a number."""

    texts: Sequence[str] = (name, *others)
    return F.coalesce(*[F.try_element_at("cells", F.lit(t)) for t in texts]).try_cast("double")


def text(name: str) -> Column:
    """A column of a line as text."""

    return F.try_element_at("cells", F.lit(name))
