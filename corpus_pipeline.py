"""From documents to packed training windows: five operators, each written before the next reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceworks.llm import packing, quality, simhash, substrings, toxicity
from sliceworks.llm.common import crc_of
from sliceworks.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""

    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality_columns(docs, model).filter("kept").select(*docs.columns)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""

    labels = table(spark, sf_dir, "labels").filter(crc_of("doc_id") % 5 != 0)
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; see ``one_of_each``
    for null and repeated ids."""

    return simhash.one_of_each(docs)


def unrepeated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word sequences that an earlier one has; texts without any stay as they
    are."""

    found = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        .cast("long")).select(*docs.columns)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens."""

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", good_documents), ("toxicity", civil_documents),
          ("simhash near-dedup", distinct_documents), ("substring dedup", unrepeated_documents),
          ("packing", packed_documents)]
#: No SQL: the stages' models and tokenizers have none. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
