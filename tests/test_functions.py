"""Tokens, bit strings, numbers, row rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sliceworks.functions.bits import bit_errors, normalize_bits
from sliceworks.functions.numbers import parse_number, parse_timestamp, safe_ratio
from sliceworks.functions.tokens import (
    count_distinct_tokens, count_token, parse_tokens, share_in_set, split_outside_brackets,
)
from sliceworks.operators.features import (
    SequenceColumns, add_ratio_features, add_sequence_features, fit_categories, one_hot,
)
from sliceworks.operators.rules import (
    BitStringRule, PositiveLengthRule, RangeRule, RequiredRule, TimestampRule, check_rows,
    coerce_types, issue_counts, issue_ranges, split_valid,
)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize("text, delimiters, expected", [
    ("H->CX;RX", [",", ";", "->"], ["h", "cx", "rx"]),
    ("U3(theta,phi,lambda), CX[q0,q1]; RZZ(pi/2) -> measure", [",", ";", "->"],
     ["u3", "cx", "rzz", "measure"]),
    ("'Q:CX' , \"a b\"", [","], ["cx", "a"]),
    ("12,a:b:,:", [","], ["12", "b", ":"]),
    (None, [","], []), ("   ", [","], []),
])
def test_tokens(spark, text, delimiters, expected):
    df = texts(spark, [text])
    assert column(df, parse_tokens(F.col("t"), delimiters)) == [expected]


def test_brackets_protect_delimiters(spark):
    df = texts(spark, ["U3(theta,phi,lambda), CX[q0,q1]; RZZ(pi/2)", "a(b,c", "x),y", "([)],b],c"])
    assert column(df, split_outside_brackets(F.col("t"), [",", ";"])) == [
        ["U3(theta,phi,lambda)", "CX[q0,q1]", "RZZ(pi/2)"], ["a(b,c"], ["x)", "y"],
        ["([)]", "b]", "c"]]


def split_by_hand(text, delimiters):
    """One character at a time, as a check of the run-wise expression."""

    pairs = {")": "(", "]": "[", "}": "{"}
    open_now = {"(": 0, "[": 0, "{": 0}
    parts, place = [""], 0
    while place < len(text):
        found = [d for d in sorted(delimiters, key=len, reverse=True) if text.startswith(d, place)]
        if found and not any(open_now.values()):
            parts.append("")
            place += len(found[0])
            continue
        c = text[place]
        if c in open_now:
            open_now[c] += 1
        elif c in pairs:
            open_now[pairs[c]] = max(0, open_now[pairs[c]] - 1)
        parts[-1] += c
        place += 1
    return [p.strip() for p in parts if p.strip()]


def test_split_against_brute_force(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ab ,;->()[]{}") for _ in range(rng.randint(0, 40)))
              for _ in range(300)]
    delimiters = [",", ";", "->", "-"]
    got = column(texts(spark, values), split_outside_brackets(F.col("t"), delimiters))
    assert got == [split_by_hand(v, delimiters) for v in values]


def test_delimiter_with_bracket_is_refused():
    with pytest.raises(ValueError, match="bracket"):
        split_outside_brackets(F.lit("a"), ["("])


def test_token_counts(spark):
    df = texts(spark, ["H,CX,RX,CX", ""])
    tokens = parse_tokens(F.col("t"), [","])
    assert column(df, count_token(tokens, "CX")) == [2, 0]
    assert column(df, count_distinct_tokens(tokens)) == [3, 0]
    assert column(df, share_in_set(tokens, ["cx", "cz", "swap"])) == [0.5, 0.0]


def test_bit_errors(spark):
    long_a, long_b = "01" * 70, "10" + "01" * 69
    pairs = [("0011", "0110", 2), ("001", "0011", None), (None, "1", None), ("ab", "ac", 1),
             ("1" * 63, "0" * 63, 63), (long_a, long_b, 2), ("0" * 64, "1" * 64, 64)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(bit_errors(F.col("a"), F.col("b"))).collect()]
    assert got == [n for *_, n in pairs]


@pytest.mark.parametrize("bits, length, align, expected", [
    ("101", 5, True, ("00101", True, None)), ("101", 3, True, ("101", False, None)),
    ("101", 5, False, (None, False, "bitstring_shorter_than_length")),
    (None, 5, True, (None, False, "missing_bitstring")), ("  ", 5, True, (None, False, "empty_bitstring")),
    ("1", 0, True, (None, False, "invalid_length")), ("1a1", 2, True, (None, False, "non_binary_bitstring")),
    ("10101", 4, True, (None, False, "bitstring_longer_than_length")),
])
def test_normalize_bits(spark, bits, length, align, expected):
    df = spark.createDataFrame([(bits, length)], "b string, n int")
    parts = normalize_bits(F.col("b"), F.col("n"), align=align)
    assert tuple(df.select(*parts).first()) == expected


def test_numbers_and_times(spark):
    df = texts(spark, ["1.0d", " 1e3 ", "nan", "x", None, "-.5"])
    assert column(df, parse_number(F.col("t"))) == [None, 1000.0, None, None, None, -0.5]
    times = texts(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00", "no"])
    got = column(times, F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05"] * 3 + [None]
    pairs = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, float("nan")), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in pairs.select(safe_ratio(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 0.25]


def raw_log(spark, **changes):
    row = {"circuit_id": "c1", "qubit_count": "5", "gate_depth": "3", "gate_types": "H,CX",
           "error_rate_gate": "0.1", "t1_time": "50", "t2_time": "25", "readout_error": "0.01",
           "shots": "100", "bitstring": "101", "ideal_bitstring": "00001", "fidelity": "0.9",
           "timestamp": "2024-01-01T00:00:00", "device_type": "x", "error_type": "none"}
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


LOG_RULES = [
    PositiveLengthRule("qubit_count"), RequiredRule("circuit_id"), RequiredRule("gate_types"),
    RequiredRule("error_type"), RangeRule("gate_depth", 0.0), RangeRule("error_rate_gate", 0.0, 1.0),
    RangeRule("t1_time", 0.0, inclusive_min=False), RangeRule("shots", 0.0, inclusive_min=False),
    RangeRule("fidelity", 0.0, 1.0), TimestampRule("timestamp"),
    BitStringRule("bitstring", "qubit_count"), BitStringRule("ideal_bitstring", "qubit_count"),
]


def checked_log(spark, **changes):
    typed = coerce_types(
        raw_log(spark, **changes), string_columns=["circuit_id", "gate_types", "bitstring",
                                                   "ideal_bitstring", "error_type"],
        numeric_columns=["qubit_count", "gate_depth", "error_rate_gate", "t1_time", "shots", "fidelity"],
        timestamp_column="timestamp", index_column="circuit_id")
    return check_rows(typed, LOG_RULES)


def test_valid_row_is_aligned(spark):
    row = checked_log(spark).first()
    assert row["is_valid_for_modeling"] and row["validation_issues"] == ""
    assert (row["bitstring_aligned"], row["bitstring_was_padded"]) == ("00101", True)
    assert (row["ideal_bitstring_aligned"], row["ideal_bitstring_was_padded"]) == ("00001", False)
    assert row["raw_row_index"] == "c1"


@pytest.mark.parametrize("changes, issues", [
    ({"t1_time": "-1.5"}, "out_of_range_t1_time"), ({"shots": "many"}, "missing_or_invalid_shots"),
    ({"qubit_count": "0.5"}, "invalid_qubit_count;bitstring:invalid_qubit_count;ideal_bitstring:invalid_qubit_count"),
    ({"gate_types": "  ", "timestamp": "later"}, "missing_gate_types;invalid_timestamp"),
    ({"bitstring": "1012"}, "bitstring:non_binary_bitstring"),
    ({"fidelity": "1.5", "error_rate_gate": "-0.1"}, "out_of_range_error_rate_gate;out_of_range_fidelity"),
])
def test_issues(spark, changes, issues):
    assert checked_log(spark, **changes).first()["validation_issues"] == issues


def test_issue_report(spark):
    prepared = split_valid(checked_log(spark, t1_time="-1.5").drop(
        "validation_issues", "validation_expected_conditions", "validation_issue_details",
        "is_valid_for_modeling", "bitstring_aligned", "bitstring_was_padded",
        "ideal_bitstring_aligned", "ideal_bitstring_was_padded"), LOG_RULES)
    assert (prepared.valid.count(), prepared.invalid.count()) == (0, 1)
    assert issue_counts(prepared.checked).first().asDict() == {
        "issue": "out_of_range_t1_time", "issue_count": 1}
    ranges = issue_ranges(prepared.checked).first()
    assert (ranges["expected_condition"], ranges["observed_min"], ranges["observed_max"]) == (
        "> 0.0", -1.5, -1.5)


def test_expected_conditions():
    assert RangeRule("x", 0, 1).expected_condition() == ">= 0.0 and <= 1.0"
    assert RangeRule("x", 0, inclusive_min=False).expected_condition() == "> 0.0"
    assert RangeRule("x", max_value=2, inclusive_max=False).expected_condition() == "< 2.0"
    assert RangeRule("x").expected_condition() == "any numeric value"


def test_sequence_and_ratio_features(spark):
    df = spark.createDataFrame(
        [("H,CX,RX,CX", 4, 8, 50.0, 25.0, "0101", "0001")],
        "s string, n int, d int, t1 double, t2 double, bitstring string, ideal string")
    columns = SequenceColumns("s", "d", "n", "t1", "t2", "bitstring_aligned", "ideal")
    row = add_sequence_features(df, columns).first()
    assert [row[c] for c in ("num_cx", "two_qubit_ratio", "unique_gates", "cx_density", "t2_t1_ratio",
                             "bit_errors", "observed_error_rate")] == [2, 0.5, 3, 0.25, 0.5, 1, 0.25]
    ratio = spark.createDataFrame([(8, 4, 0.02, 0.01, 50.0, 25.0, 0.6, 2.0)],
                                  "d int, n int, g double, r double, a double, b double, f double, e double")
    row = add_ratio_features(ratio, length="n", depth="d", gate_error="g", readout_error="r",
                             relaxation="a", coherence="b", fidelity="f", errors="e").first()
    expected = [2.0, 0.16, 0.5, 25, 25, 0.4, 0.25]
    got = [row[c] for c in ("depth_per_qubit", "error_depth_load", "readout_to_gate_error_ratio",
                            "coherence_gap", "coherence_min", "fidelity_loss", "bit_error_density")]
    assert got == pytest.approx(expected)


def test_one_hot_uses_fitted_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    other = spark.createDataFrame([("a",), ("new",), (None,)], "c string")
    encoded = one_hot(other, fit_categories(train, ["c"]))
    assert encoded.columns == ["c_a", "c_b"]
    assert [tuple(r) for r in encoded.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_many_categories_are_an_error_before_they_are_fetched(spark):
    from sliceworks.models.prep import classification_prep
    from sliceworks.operators.splits import split_stratified

    wide = spark.range(1_000_000).select("id", F.concat(F.lit("text "), F.col("id")).alias("t"))
    for fit in (lambda: fit_categories(wide, ["t"]), lambda: classification_prep(["t"]).fit(wide),
                lambda: split_stratified(wide, ["id"], "t")):
        with pytest.raises(ValueError, match="more than 100000"):
            fit()


def test_code_tables_number_categories_in_order(spark):
    from sliceworks.operators.categories import category_codes, sparse_one_hot, with_codes

    words = [f"w{k * 7919 % 500}" for k in range(900)] + [None, "", "é", "Z"]
    train = spark.createDataFrame([(k, w, "x" if k % 2 else None) for k, w in enumerate(words)], "k int, t string, u string")
    codes = category_codes(train, ["t", "u"])
    texts = sorted({w for w in words if w is not None}, key=str.encode)
    found = {(r["column"], r["category"]): (r["code"], r["category_rows"]) for r in codes.collect()}
    assert found == {("t", w): (k, words.count(w)) for k, w in enumerate(texts)} | {
        ("u", "x"): (0, sum(k % 2 for k in range(len(words))))}
    other = spark.createDataFrame([(0, "é"), (1, "never"), (2, None), (3, texts[1])], "k int, t string")
    assert {r.k: r.c for r in with_codes(other, codes, "t", "c").collect()} == {
        0: len(texts) - 1, 1: None, 2: None, 3: 1}
    vectors = {r.k: r.v for r in sparse_one_hot(other, codes, "t", "v").collect()}
    assert {k: (v.size, list(v.indices)) for k, v in vectors.items()} == {
        0: (len(texts), [len(texts) - 1]), 1: (len(texts), []), 2: (len(texts), []), 3: (len(texts), [1])}
    assert category_codes(train.limit(0), ["t"]).count() == 0
