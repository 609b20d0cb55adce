"""Values that once stopped a job, lost rows or moved cells."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sliceworks.functions.bits import normalize_bits
from sliceworks.functions.tokens import count_token, parse_tokens, plain_token, share_in_set
from sliceworks.operators.ordering import exact_quantiles, order_key, with_running_totals
from sliceworks.operators.profile import column_profile
from sliceworks.operators.rules import BitStringRule, PositiveLengthRule
from sliceworks.operators.splits import split_stratified, with_folds
from sliceworks.plans.registry import bits
from sliceworks.sources.runs import scan_tables
from sliceworks.sources.tables import read_table


def test_lengths_that_are_no_whole_numbers(spark):
    df = spark.createDataFrame([("101", x) for x in (float("nan"), float("inf"), 3e9, 1e300, 4.0, None)],
                               "b string, n double")
    rows = df.select(PositiveLengthRule("n").issue().isNotNull().alias("length"),
                     BitStringRule("b", "n").issue().isNotNull().alias("bits")).collect()
    assert [r.bits for r in rows] == [True, True, True, True, False, True]
    assert [r.length for r in rows] == [True, True, False, True, False, True]


def test_bits_with_line_feeds(spark):
    df = spark.createDataFrame([("101\n",), ("\t101",), ("10\n1",)], "b string")
    found = normalize_bits(F.col("b"), F.lit(4.0))
    rows = df.select(found.aligned.alias("a"), found.issue.alias("i")).collect()
    assert [(r.a, r.i) for r in rows] == [("0101", None), ("0101", None), (None, "non_binary_bitstring")]


def test_wide_numbers_keep_their_bits(spark):
    row = spark.range(1).select(bits(F.lit(2**33 + 5), 32).alias("b"), bits(F.lit(5), 8).alias("c")).first()
    assert int(row.b, 2) == 2**33 + 5 and row.c == "00000101"


def test_rows_without_group_get_a_fold(spark):
    df = spark.createDataFrame([(k, None if k < 4 else k % 3) for k in range(12)], "id long, g long")
    rows = with_folds(df, "g", 3).collect()
    assert len(rows) == 12 and len({r.fold for r in rows if r.g is None}) == 1


def test_stratified_split_names_empty_labels(spark):
    df = spark.createDataFrame([(k, None if k == 3 else "a") for k in range(9)], "id long, y string")
    with pytest.raises(ValueError, match="without a value"):
        split_stratified(df, ["id"], "y")


def test_wide_and_nameless_columns(spark, tmp_path):
    folder = tmp_path / "family" / "run"
    folder.mkdir(parents=True)
    names = [f"c{k}" for k in range(120)]
    lines = [",".join(["", *names]), ",".join(["0", *map(str, range(119)), '"x, ""y"""'])]
    (folder / "wide.csv").write_text("\n".join(lines) + "\n")
    cells = scan_tables(spark, str(tmp_path / "family"), "wide.csv").first().cells
    assert len(cells) == 120 and cells["c0"] == "0" and cells["c118"] == "118"
    assert cells["c119"] == 'x, "y"'


def test_different_ids_have_different_keys(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("\\N", "x"),
                                ("a\\", "|b"), ("a", "\\|b"), ("", "x")], "a string, b string")
    assert df.select(order_key(1, "a", "b")).distinct().count() == 8
    assert spark.range(1).select(order_key(42, "id") == F.md5(F.lit("42|0"))).first()[0]


def test_odd_scores_are_ordered_alike_at_every_size(spark):
    scores = [None, float("-inf"), -1.0, 0.5, 2.0, 7.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(s, 10 ** k) for k, s in enumerate(scores)], "s double, n long")
    for limit in (5, 10**6):
        found = with_running_totals(rows, "s", {"n": "before"}, bucket_rows=limit).collect()
        assert {r.n: r.before for r in found} == {10 ** k: int("0" + "1" * k) for k in range(8)}


@pytest.mark.parametrize("limit", [10**6, 5])
def test_quantiles_of_odd_values_are_those_of_pandas(spark, limit):
    inf, nan = float("inf"), float("nan")
    columns = {"x": [-inf] * 3 + [float(k) for k in range(40)] + [inf, nan, None],
               "y": [None] * 46, "z": [nan] * 45 + [2.0], "w": [7.5] * 46}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "x double, y double, z double, w double")
    wanted = [0.0, 0.25, 0.5, 0.61, 0.8, 1.0]
    found = exact_quantiles(df, dict.fromkeys(columns, wanted), limit=limit)
    for name, values in columns.items():
        plain = pd.Series(values, dtype=float).dropna()
        same = [None if plain.empty else float(plain.sort_values().iloc[0]) if p == 0 else
                float(plain.sort_values().iloc[-1]) if p == 1 else float(plain.quantile(p)) for p in wanted]
        assert [x if x is None or math.isinf(x) else round(x, 9) for x in found[name]] == [
            x if x is None or math.isinf(x) else round(x, 9) for x in same], name


def test_passes_of_quantiles_do_not_grow_with_columns(spark, monkeypatch):
    """Ten columns take as many aggregations as one, with samples smaller than the table."""

    from sliceworks.operators import ordering

    monkeypatch.setattr(ordering, "SAMPLE_ROWS", 2000)
    monkeypatch.setattr(ordering, "SLACK", 0.02)
    rows = spark.range(40_000).select(*[
        F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10 ** (k + 1))).cast("double").alias(f"c{k}") for k in range(10)])
    data = rows.toPandas()
    passes = {}
    for n in (1, 10):
        jobs = []
        kept = type(rows).agg
        monkeypatch.setattr(type(rows), "agg", lambda self, *a: jobs.append(1) or kept(self, *a))  # noqa: B023
        names = rows.columns[-n:]
        found = exact_quantiles(rows, {c: (0.01, 0.5, 0.75) for c in names}, limit=500)
        monkeypatch.setattr(type(rows), "agg", kept)
        passes[n] = len(jobs)
        for c in names:
            assert found[c] == pytest.approx(data[c].quantile([0.01, 0.5, 0.75]).tolist())
    assert passes[10] <= passes[1] + 4


def test_names_are_written_as_tokens_may_be(spark):
    cases = ["lib:CX", "CX(q0)", " 'H' ", "a:b:", "12", "x::", "Rz(0.5)"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(
        "t", parse_tokens(F.col("t"), [";"]).alias("p")).collect()
    assert {r.t: r.p for r in rows} == {c: [plain_token(c)] for c in cases}
    tokens = parse_tokens(F.lit("cx; lib:CX; h"), [";"])
    row = spark.range(1).select(count_token(tokens, "lib:CX"), share_in_set(tokens, ["CX(q0)"])).first()
    assert row[0] == 2 and row[1] == pytest.approx(2 / 3)


def test_both_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0, "a" * 70), (-0.0, "a" * 71), (1.0, "b")], "x double, t string")
    found = {r.column: r.distinct_count for r in column_profile(df).collect()}
    assert found == {"x": 2, "t": 3}


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    path = str(tmp_path / "broken.csv")
    texts = ["one\ntwo", 'say ""x""', "plain"]
    spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).write.csv(
        path, header=True, escape='"')
    found = read_table(spark, path, string_columns=["t"]).orderBy("k").collect()
    assert [r.t for r in found] == texts
