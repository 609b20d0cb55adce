"""Queries on row rules, coercion, bit strings, tokens and row features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceworks.functions.tokens import (
    count_distinct_tokens, count_token, parse_tokens, share_in_set,
)
from sliceworks.operators.categories import category_codes, with_codes
from sliceworks.operators.features import (
    SequenceColumns, add_ratio_features, add_sequence_features, decode_labels, fit_categories,
    fit_label_codes, nested_feature_tables, one_hot,
)
from sliceworks.operators.rules import (
    BitStringRule, PositiveLengthRule, RangeRule, RequiredRule, TimestampRule, check_rows,
    coerce_types, issue_counts, issue_ranges, split_valid, validation_summary,
)
from sliceworks.operators.splits import split_groups
from sliceworks.operators.subsets import drop_columns, filter_subset, filter_variants
from sliceworks.operators.target import agreement_target, target_summary
from sliceworks.plans.registry import bits, query, rounded, table
from sliceworks.plans.sql import GROUPED_ORDERS, PART_BITS, PART_SEQUENCE

LINEITEM_RULES = (
    RangeRule("l_discount", 0.0, 0.05), RangeRule("l_quantity", 0.0, inclusive_min=False),
    RangeRule("l_tax", 0.0, 0.06),
)

# The rules of LINEITEM_RULES as SQL; no value is missing there.
LINEITEM_CHECKED = """
WITH checked AS (
  SELECT *, list_filter([
    CASE WHEN NOT (l_discount >= 0 AND l_discount <= 0.05::DOUBLE) THEN 'out_of_range_l_discount' END,
    CASE WHEN NOT l_quantity > 0 THEN 'out_of_range_l_quantity' END,
    CASE WHEN NOT (l_tax >= 0 AND l_tax <= 0.06::DOUBLE) THEN 'out_of_range_l_tax' END
  ], lambda x: x IS NOT NULL) AS issues,
  list_filter([
    CASE WHEN NOT (l_discount >= 0 AND l_discount <= 0.05::DOUBLE) THEN 'l_discount: >= 0.0 and <= 0.05' END,
    CASE WHEN NOT l_quantity > 0 THEN 'l_quantity: > 0.0' END,
    CASE WHEN NOT (l_tax >= 0 AND l_tax <= 0.06::DOUBLE) THEN 'l_tax: >= 0.0 and <= 0.06' END
  ], lambda x: x IS NOT NULL) AS conditions FROM lineitem)
"""


def _checked_lineitem(spark: SparkSession, sf_dir: str):
    return split_valid(table(spark, sf_dir, "lineitem"), LINEITEM_RULES)


@query("validation_issue_counts", LINEITEM_CHECKED + """
SELECT issue, count(*) AS issue_count FROM (SELECT unnest(issues) AS issue FROM checked) GROUP BY issue
""")
def validation_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_counts(_checked_lineitem(spark, sf_dir).checked)


@query("valid_rows", LINEITEM_CHECKED + """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_quantity, l_tax, '' AS validation_issues
FROM checked WHERE len(issues) = 0
""")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_lineitem(spark, sf_dir).valid.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_tax",
        "validation_issues")


@query("quarantine_rows", LINEITEM_CHECKED + """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_quantity, l_tax,
  array_to_string(issues, ';') AS validation_issues,
  array_to_string(conditions, ';') AS validation_expected_conditions
FROM checked WHERE len(issues) > 0
""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_lineitem(spark, sf_dir).invalid.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_tax",
        "validation_issues", "validation_expected_conditions")


@query("issue_observed_range", """
WITH rows AS (SELECT *, bin(l_partkey) AS bits FROM lineitem),
issues AS (
  SELECT 'out_of_range_l_discount' AS issue, l_discount AS number, NULL AS word FROM rows
  WHERE NOT (l_discount >= 0 AND l_discount <= 0.05::DOUBLE)
  UNION ALL SELECT 'out_of_range_l_tax', l_tax, NULL FROM rows
  WHERE NOT (l_tax >= 0 AND l_tax <= 0.06::DOUBLE)
  UNION ALL SELECT 'bits:bitstring_longer_than_width', NULL, bits FROM rows WHERE length(bits) > 7),
words AS (SELECT issue, word, row_number() OVER (PARTITION BY issue ORDER BY word) AS rn
          FROM (SELECT DISTINCT issue, word FROM issues WHERE word IS NOT NULL))
SELECT issue, count(*) AS issue_count, min(number) AS observed_min, max(number) AS observed_max,
  coalesce((SELECT string_agg(word, ',' ORDER BY word) FROM words w WHERE w.issue = i.issue AND rn <= 5), '') AS samples
FROM issues i GROUP BY issue
""")
def issue_observed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "bits": bits("l_partkey"), "width": F.lit(7)})
    rules = [RangeRule("l_discount", 0.0, 0.05), RangeRule("l_tax", 0.0, 0.06),
             BitStringRule("bits", "width")]
    return issue_ranges(check_rows(rows, rules)).select(
        "issue", "issue_count", "observed_min", "observed_max",
        F.array_join("sample_observed_values", ",").alias("samples"))


@query("validation_overview", """
WITH rows AS (SELECT *, bin(p_partkey) AS bits, 12 AS width FROM part),
flags AS (SELECT *, NOT (p_size >= 5 AND p_size <= 40) OR length(bits) > width AS bad,
          length(bits) < width AS padded FROM rows)
SELECT 'rows_read' AS measure, count(*) AS value FROM flags
UNION ALL SELECT 'rows_valid', count(*) FILTER (NOT bad) FROM flags
UNION ALL SELECT 'rows_invalid', count(*) FILTER (bad) FROM flags
UNION ALL SELECT 'missing:p_name', count(*) FILTER (p_name IS NULL) FROM flags
UNION ALL SELECT 'missing:p_size', count(*) FILTER (p_size IS NULL) FROM flags
UNION ALL SELECT 'padded:bits', count(*) FILTER (padded) FROM flags
""")
def validation_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumns({"bits": bits("p_partkey"), "width": F.lit(12)})
    prepared = split_valid(rows, [RangeRule("p_size", 5, 40), BitStringRule("bits", "width")])
    return validation_summary(prepared, ["p_name", "p_size"])


@query("typed_coercion", """
SELECT event_id, event_id AS raw_row_index, event_type,
  TRY_CAST(props->>'$.k' AS DOUBLE) AS k, NULL::DOUBLE AS type_number,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text
FROM events
""")
def typed_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("  "), "event_type").alias("event_type"),
        F.concat(F.get_json_object("props", "$.k"), F.lit(" ")).alias("k"),
        F.col("event_type").alias("type_number"), F.col("ts").cast("string").alias("ts"))
    typed = coerce_types(raw, string_columns=["event_type"], numeric_columns=["k", "type_number"],
                         timestamp_column="ts", index_column="event_id")
    return typed.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("ts")


@query("required_values", """
WITH rows AS (
  SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment,
    c_acctbal / 10000 AS length FROM customer),
issues AS (
  SELECT *, list_filter([
    CASE WHEN trunc(length) <= 0 THEN 'invalid_length' END,
    CASE WHEN segment IS NULL THEN 'missing_segment' END], lambda x: x IS NOT NULL) AS found
  FROM rows)
SELECT c_custkey, segment, array_to_string(found, ';') AS validation_issues,
  len(found) = 0 AS is_valid_for_modeling FROM issues
""")
def required_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        (F.col("c_acctbal") / 10000).alias("length"))
    rules = [PositiveLengthRule("length"), RequiredRule("c_name"), RequiredRule("segment")]
    return check_rows(drop_columns(rows, ["c_nationkey", "not_there"]), rules).select(
        "c_custkey", "segment", "validation_issues", "is_valid_for_modeling")


@query("timestamp_rule", """
SELECT CASE WHEN event_type = 'error' THEN 'invalid_seen_at' ELSE '' END AS validation_issues,
  count(*) AS row_count FROM events GROUP BY 1
""")
def timestamp_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    raw = table(spark, sf_dir, "events").select("event_id", seen.alias("seen_at"))
    typed = coerce_types(raw, timestamp_column="seen_at", index_column="event_id")
    return check_rows(typed, [TimestampRule("seen_at")]).groupBy("validation_issues").agg(
        F.count(F.lit(1)).alias("row_count"))


def _part_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("p_size") == 1, F.col("p_brand")).when(F.col("p_size") == 2, "")
        .when(F.col("p_size") == 3, F.lit(None)).otherwise(bits("p_partkey"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.alias("bits"), (F.col("p_partkey") % 9 + F.col("p_size") % 5).alias("width"))


@query("bitstring_alignment", PART_BITS + """
SELECT p_partkey,
  CASE WHEN issue IS NULL THEN lpad(bits, width::INT, '0') END AS bits_aligned,
  issue IS NULL AND length(bits) < width AS bits_was_padded,
  CASE WHEN issue IS NULL THEN '' ELSE 'bits:' || issue END AS validation_issues
FROM judged
""")
def bitstring_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_rows(_part_bits(spark, sf_dir), [BitStringRule("bits", "width")])
    return checked.select("p_partkey", "bits_aligned", "bits_was_padded", "validation_issues")


@query("bitstring_no_padding", PART_BITS + """
SELECT coalesce(issue, CASE WHEN length(bits) < width THEN 'bitstring_shorter_than_width' END, 'none')
  AS issue, count(*) AS row_count FROM judged GROUP BY 1
""")
def bitstring_no_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_rows(_part_bits(spark, sf_dir), [BitStringRule("bits", "width", align=False)])
    issue = F.regexp_replace("validation_issues", "^bits:", "")
    return checked.groupBy(F.when(issue == "", "none").otherwise(issue).alias("issue")).agg(
        F.count(F.lit(1)).alias("row_count"))


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", bits("l_partkey", 32).alias("seen"), bits("l_suppkey", 32).alias("ideal"),
        F.lit(32).alias("width"))
    return agreement_target(pairs, id_column="l_orderkey", length="width", observed="seen",
                            ideal="ideal")


HAMMING = """
WITH t AS (SELECT l_orderkey::VARCHAR AS l_orderkey, bit_count(xor(l_partkey, l_suppkey)) AS bit_errors
           FROM lineitem)
"""


@query("hamming_target", HAMMING + """
SELECT l_orderkey, bit_errors, round(1.0 - bit_errors::DOUBLE / 32, 6) AS reliability FROM t
""")
def hamming_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_agreement(spark, sf_dir), "reliability")


@query("hamming_target_summary", HAMMING + """
SELECT target, count(*) AS row_count, round(min(x), 6) AS target_min, round(max(x), 6) AS target_max,
  round(avg(x), 6) AS target_mean, round(quantile_cont(x, 0.5), 6) AS target_median
FROM (SELECT 'reliability' AS target, 1.0 - bit_errors::DOUBLE / 32 AS x FROM t
      UNION ALL SELECT 'bit_errors', bit_errors::DOUBLE FROM t) GROUP BY target
""")
def hamming_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = target_summary(_agreement(spark, sf_dir), ["reliability", "bit_errors"])
    return rounded(summary, "target_min", "target_max", "target_mean", "target_median")


def _part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_type", F.lit("("), "p_brand", F.lit(","), "p_size", F.lit(") ;' q:"),
                    F.regexp_replace("p_name", " ", "'->"))
    return table(spark, sf_dir, "part").withColumn("sequence", text)


@query("token_counts", PART_SEQUENCE + """
SELECT p_partkey, array_to_string(tokens, ',') AS tokens, len(list_filter(tokens, lambda t: t = 'ring')) AS ring_count,
  len(list_distinct(tokens)) AS distinct_tokens,
  round(len(list_filter(tokens, lambda t: t IN ('ring', 'widget', 'economy')))::DOUBLE / len(tokens), 6) AS set_share
FROM seq
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.col("tokens")
    rows = _part_sequences(spark, sf_dir).withColumn(
        "tokens", parse_tokens(F.col("sequence"), [",", ";", "->"]))
    return rows.select(
        "p_partkey", F.array_join("tokens", ",").alias("tokens"),
        count_token(tokens, " 'RING'").alias("ring_count"),
        count_distinct_tokens(tokens).alias("distinct_tokens"),
        F.round(share_in_set(tokens, ["ring", "widget", "economy"]), 6).alias("set_share"))


SEQUENCE = SequenceColumns(
    sequence="sequence", depth="depth", length="width", relaxation="t1", coherence="t2",
    observed="bits_aligned", ideal="ideal_aligned", counted_token="ring",
    token_set=("ring", "widget"),
)


def _part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_sequences(spark, sf_dir).select(
        "p_partkey", "p_type", "sequence", (F.col("p_size") - 1).alias("depth"), F.lit(32).alias("width"),
        (F.col("p_partkey") % 7).alias("t1"), (F.col("p_retailprice") / 100).alias("t2"),
        bits("p_partkey", 32).alias("bits_aligned"), bits("p_size", 32).alias("ideal_aligned"),
        (F.col("p_size") % 4 / 10.0).alias("gate_error"),
        F.expr("nullif(p_size % 6, 5) / 10.0").alias("readout"),
        (F.col("p_size") / 25.0).alias("fidelity"))


SEQUENCE_FEATURES_SQL = PART_SEQUENCE + """
, feats AS (
  SELECT p_partkey, p_type, p_size - 1 AS depth, p_partkey % 7 AS t1, p_retailprice / 100 AS t2,
    (p_size % 4) / 10.0::DOUBLE AS gate_error, nullif(p_size % 6, 5) / 10.0::DOUBLE AS readout,
    p_size / 25.0::DOUBLE AS fidelity,
    len(list_filter(tokens, lambda t: t = 'ring'))::DOUBLE AS num_cx,
    len(list_filter(tokens, lambda t: t IN ('ring', 'widget')))::DOUBLE / len(tokens) AS two_qubit_ratio,
    len(list_distinct(tokens))::DOUBLE AS unique_gates,
    bit_count(xor(p_partkey, p_size::BIGINT))::DOUBLE AS bit_errors FROM seq)
"""


@query("sequence_features", SEQUENCE_FEATURES_SQL + """
SELECT p_partkey, num_cx, round(two_qubit_ratio, 6) AS two_qubit_ratio, unique_gates, bit_errors,
  round(CASE WHEN depth = 0 THEN 0 ELSE num_cx / depth END, 6) AS cx_density,
  round(CASE WHEN t1 = 0 THEN 0 ELSE t2 / t1 END, 6) AS t2_t1_ratio,
  round(bit_errors / 32, 6) AS observed_error_rate FROM feats
""")
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = add_sequence_features(_part_log(spark, sf_dir), SEQUENCE).select(
        "p_partkey", "num_cx", "two_qubit_ratio", "unique_gates", "bit_errors", "cx_density",
        "t2_t1_ratio", "observed_error_rate")
    return rounded(features, "two_qubit_ratio", "cx_density", "t2_t1_ratio", "observed_error_rate")


@query("row_ratio_features", """
SELECT l_orderkey, l_linenumber, l_partkey,
  round(CASE WHEN l_linenumber - 1 = 0 THEN 0 ELSE l_quantity / (l_linenumber - 1) END, 6) AS depth_per_qubit,
  round(l_discount * l_quantity, 6) AS error_depth_load,
  round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS readout_to_gate_error_ratio,
  round(l_extendedprice / 1000 - l_quantity, 6) AS coherence_gap,
  round(least(l_extendedprice / 1000, l_quantity), 6) AS coherence_min,
  round(greatest(0, 1 - l_discount * 20), 6) AS fidelity_loss,
  round(CASE WHEN l_quantity = 0 THEN 0 ELSE l_suppkey / l_quantity END, 6) AS bit_error_density
FROM lineitem
""")
def row_ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") - 1).alias("width"),
        F.col("l_quantity").alias("depth"), F.col("l_discount").alias("gate_error"),
        F.col("l_tax").alias("readout"), (F.col("l_extendedprice") / 1000).alias("t1"),
        F.col("l_quantity").alias("t2"), (F.col("l_discount") * 20).alias("fidelity"),
        F.col("l_suppkey").alias("errors"))
    names = ["depth_per_qubit", "error_depth_load", "readout_to_gate_error_ratio", "coherence_gap",
             "coherence_min", "fidelity_loss", "bit_error_density"]
    featured = add_ratio_features(
        rows, length="width", depth="depth", gate_error="gate_error", readout_error="readout",
        relaxation="t1", coherence="t2", fidelity="fidelity", errors="errors")
    return rounded(featured.select("l_orderkey", "l_linenumber", "l_partkey", *names), *names)


@query("nested_features", SEQUENCE_FEATURES_SQL + """
SELECT p_partkey, p_type, gate_error, round(two_qubit_ratio, 6) AS two_qubit_ratio,
  round(CASE WHEN depth = 0 THEN 0 ELSE bit_errors / depth END, 6) AS bit_error_density,
  round(CASE WHEN gate_error = 0 THEN 0 ELSE coalesce(readout, 0) / gate_error END, 6) AS readout_to_gate_error_ratio,
  4 AS baseline_width, 11 AS topology_width, 18 AS enhanced_width FROM feats
""")
def nested_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = nested_feature_tables(
        _part_log(spark, sf_dir), id_column="p_partkey", label_column="p_type",
        base_columns=["gate_error", "depth"], sequence=SEQUENCE, gate_error="gate_error",
        readout_error="readout", fidelity="fidelity")
    widths = {name.split("_")[0] + "_width": F.lit(len(t.columns)) for name, t in tables.items()}
    enhanced = tables["enhanced_topology"].select(
        "p_partkey", "p_type", "gate_error", "two_qubit_ratio", "bit_error_density",
        "readout_to_gate_error_ratio").withColumns(widths)
    return rounded(enhanced, "two_qubit_ratio", "bit_error_density", "readout_to_gate_error_ratio")


@query("one_hot", GROUPED_ORDERS + """
SELECT o_orderkey, split_name,
""" + ",\n".join(
    f"  (o_orderpriority = '{p}' AND o_orderstatus <> 'P')::INT::DOUBLE AS \"priority_{p}\""
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
) + "\nFROM orders JOIN s USING (o_custkey)")
def one_hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the priority is missing on one status, and missing gives all zeros
    rows = split_groups(table(spark, sf_dir, "orders"), "o_custkey").select(
        "o_orderkey", "split_name",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    return one_hot(rows, fit_categories(rows.filter("split_name = 'train'"), ["priority"]))


@query("category_codes", GROUPED_ORDERS + """
, c AS (SELECT customer, dense_rank() OVER (ORDER BY customer) - 1 AS code, count(*) AS category_rows FROM (
  SELECT (o_custkey % 997)::VARCHAR || '/' || o_orderpriority AS customer FROM orders JOIN s USING (o_custkey)
  WHERE split_name = 'train') GROUP BY customer)
SELECT o_orderkey, code, category_rows FROM orders LEFT JOIN c ON customer = (o_custkey % 997)::VARCHAR || '/' || o_orderpriority
""")
def category_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, fitted on the training rows, of thousands of categories by a joined table; null if unseen."""

    rows = split_groups(table(spark, sf_dir, "orders"), "o_custkey").withColumn("customer", F.concat(
        (F.col("o_custkey") % 997).cast("string"), F.lit("/"), "o_orderpriority"))
    codes = category_codes(rows.filter("split_name = 'train'"), ["customer"])
    rows = with_codes(rows, codes, "customer", "code")
    counts = codes.select("code", "category_rows")
    return rows.join(counts, "code", "left").select("o_orderkey", "code", "category_rows")


@query("label_index", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code,
  o_orderpriority AS decoded FROM orders
""")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    codes = fit_label_codes(orders, "o_orderpriority", "code")
    coded = codes.transform(orders).select("o_orderkey", F.col("code"))
    return decode_labels(coded, codes, "code", "decoded")


@query("subset_filter", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr'
""")
def subset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_subset(table(spark, sf_dir, "documents"), "lang", "fr").rows.select(
        "doc_id", "lang", "source", "n_chars")


@query("subset_metadata", """
SELECT 'user_filter' AS subset_type, 'quality' AS filter_column, '1' AS filter_value,
  toxic::VARCHAR AS label, count(*) AS row_count FROM labels WHERE quality = 1 GROUP BY toxic
""")
def subset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_subset(table(spark, sf_dir, "labels"), "quality", "1", label_column="toxic").metadata


@query("variant_filter", """
SELECT split_name, l_returnflag, count(*) AS row_count FROM (
  SELECT l_returnflag, CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'validation'
    ELSE 'test' END AS split_name FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY ALL
""")
def variant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("l_linenumber") <= 4, "train").when(
        F.col("l_linenumber") == 5, "validation").otherwise("test")
    rows = table(spark, sf_dir, "lineitem").withColumn("split_name", split)
    return filter_variants(rows, "l_returnflag", ["R", "A"]).groupBy(
        "split_name", "l_returnflag").agg(F.count(F.lit(1)).alias("row_count"))
