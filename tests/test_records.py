"""Delimited text with quoted line breaks, long cells and odd headers, against the csv module."""

from __future__ import annotations

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceworks.sources.records import fields, has_quoted_breaks, read_lines, records, states_after
from sliceworks.sources.runs import scan_tables
from sliceworks.sources.tables import read_table


def test_states_follow_the_lines_one_by_one():
    dice = np.random.RandomState(1)
    for n in (1, 2, 3, 50):
        for _ in range(50):
            kinds, start = dice.randint(0, 4, n), int(dice.randint(2))
            state, plain = start, []
            for kind in kinds.tolist():
                state = kind >> state & 1
                plain.append(state)
            assert states_after(kinds, start).tolist() == plain


def texts(seed: int) -> list[list[str]]:
    dice = random.Random(seed)
    parts = ["plain", "", "a,b", 'say ""x"" "', "\n", "\n\n", ",\n\"", "\r\n", "é🙂", "  spaced ", '"', "x" * 300, "\x1a1"]
    cell = lambda: "".join(dice.choice(parts) for _ in range(dice.randrange(0, 5)))
    return [[str(k), cell(), cell(), "end"] for k in range(60)]


@pytest.mark.parametrize("seed,split,end", [(1, "64", "\n"), (2, "1000", "\r\n"), (3, "1m", "\n")])
def test_records_of_split_files(spark, tmp_path, seed, split, end):
    """Every record and field as the csv module reads them, wherever the file is cut."""

    rows = texts(seed)
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator=end).writerows([["k", "a", "b", "c"], *rows[part::2]])
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = read_lines(spark, str(tmp_path))
        assert has_quoted_breaks(lines)
        found = records(lines).select("file_path", "block", "at", fields(F.col("record")).alias("f"))
        found = sorted(found.collect(), key=lambda r: (r.file_path, r.block, r.at))
        assert [[x or "" for x in r.f] for r in found if r.f[0] != "k"] == rows[::2] + rows[1::2]
        back = read_table(spark, str(tmp_path), file_format="csv", string_columns=["a", "b", "c"])
        assert back.columns == ["k", "a", "b", "c"]
        back = {r.k: [r.a, r.b, r.c] for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    assert back == {int(r[0]): [x or None for x in r[1:]] for r in rows}


def test_stray_quotes_in_plain_fields_change_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,t\n1,5" pipe\n2,a"b"\n3,"two\nlines"\n4,6" pipe\n')
    found = read_table(spark, str(tmp_path / "t.csv"), string_columns=["t"]).orderBy("k").collect()
    assert [(r.k, r.t) for r in found] == [(1, '5" pipe'), (2, 'a"b"'), (3, "two\nlines"), (4, '6" pipe')]


def test_tables_without_quoted_breaks_are_read_in_place(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,t\n1,"a,b"\n2,"say ""x"""\n')
    assert not has_quoted_breaks(read_lines(spark, str(tmp_path / "t.csv")))
    table = read_table(spark, str(tmp_path / "t.csv"), string_columns=["t"])
    assert [f.endswith("t.csv") for f in table.inputFiles()] == [True]
    assert [(r.k, r.t) for r in table.collect()] == [(1, "a,b"), (2, 'say "x"')]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))


def test_run_tables_with_long_cells_breaks_and_odd_headers(spark, tmp_path):
    """A cell of a megabyte, doubled quotes by the hundred thousand, repeated and blank names."""

    long, doubled = "x" * 1_000_000, '"' * 300_000
    rows = [["m", "note", "m", "", "v"], ["one", long, "again", "gone", "1"], ["two\nlines", doubled, "", "g", "2"]]
    folder = tmp_path / "family" / "run_1"
    folder.mkdir(parents=True)
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    (folder / "t.csv").write_text(out.getvalue().replace("\r\n1", "\r\n\r\n1"), newline="")
    found = scan_tables(spark, str(tmp_path / "family"), "t.csv").orderBy("line_number").collect()
    assert [r.line_number for r in found] == [0, 1] and {r.run_name for r in found} == {"run_1"}
    assert found[0].cells == {"m": "one", "note": long, "m.1": "again", "v": "1"}
    assert found[1].cells == {"m": "two\nlines", "note": doubled, "m.1": None, "v": "2"}
    assert scan_tables(spark, str(tmp_path / "family"), "none.csv") is None
