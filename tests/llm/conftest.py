from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parents[1]), str(Path(__file__).parent)]

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
ODD = ("id long, text string, n_words string, score string, ids long, kept long, source string")


@pytest.fixture(scope="session")
def documents(spark):
    """Real rows with odd ones: nulls, empty and blank texts, one very long text, one very long word,
    repeated rows, control characters; and columns named like results."""

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    line = "this line of some words stands here many times and it has twenty words so that a window fits in it ok"
    rows += [(None, None), (None, "no id but words"), (9001, None), (9002, ""), (9003, " \n\t\r "),
             (9004, "many different words " + " ".join(f"w{k * k % 7919}" for k in range(60_000))),
             (9005, "x" * 50_000), (9006, "one"), (9006, "one"), (9007, "\n".join([line] * 40)),
             (9008, line + " and a tail"), (9009, "\x1c \x85 　  é é  🙂 \\ </s> <s> a'b 12 "),
             (9010, "aa " * 300)]
    return spark.createDataFrame([(k, t, "a", "b", 1, 2, "s") for k, t in rows], ODD).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)
