"""Queries on profiles, targets and column policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceworks.operators.policy import (
    classification_design, fixed_split_design, policy_audit, project_roles, regression_design,
    select_roles,
)
from sliceworks.operators.profile import (
    column_profile, constant_columns, dataset_profile, describe, duplicate_rows, feature_report,
    histogram, missing_by_column, overview, split_overview, token_count_summary,
    token_frequencies, top_sequences, value_counts, variant_counts, with_tokens,
)
from sliceworks.operators.splits import split_groups
from sliceworks.operators.target import join_target, target_design, target_summary
from sliceworks.plans.registry import query, rounded, table
from sliceworks.plans.sql import GROUPED_ORDERS, PART_SEQUENCE, split_cte

DOCUMENT_DELIMITERS = (" ", "\n", "\t", ",", ".")

# Token rules for texts without brackets: cut, trim, unquote, last colon part, identifier.
DOCUMENT_TOKENS = r"""
WITH raw AS (
  SELECT doc_id, regexp_split_to_array(translate(text, '()[]{}', '      '), ' |\n|\t|,|\.') AS parts
  FROM documents),
pieces AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS piece FROM raw),
plain AS (SELECT doc_id, place, regexp_replace(regexp_replace(lower(piece), '^\s+|\s+$', '', 'g'),
    '^["''`]+|["''`]+$', '', 'g') AS word FROM pieces WHERE regexp_replace(piece, '^\s+|\s+$', '', 'g') <> ''),
cut AS (SELECT doc_id, place, word, list_filter(string_split(word, ':'), lambda x: trim(x) <> '') AS colons FROM plain),
part AS (SELECT doc_id, place, CASE WHEN contains(word, ':') AND len(colons) > 0 THEN trim(colons[-1]) ELSE word END AS part FROM cut),
head AS (SELECT doc_id, place, part, regexp_extract(
    regexp_replace(regexp_extract(part, '^[^\s(\[{<]*'), '^[)\]}>,]+|[)\]}>,]+$', '', 'g'),
    '^[a-z][a-z0-9_]*') AS head, regexp_extract(part, '[a-z][a-z0-9_]*') AS any_name FROM part),
tokens AS (SELECT doc_id, place, CASE WHEN head <> '' THEN head WHEN any_name <> '' THEN any_name ELSE part END AS token FROM head)
"""


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(_documents(spark, sf_dir), "body", DOCUMENT_DELIMITERS)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.translate("text", "()[]{}", "      ").alias("body"))


@query("token_frequency", DOCUMENT_TOKENS + """
SELECT token, count(*) AS token_count FROM tokens WHERE token <> '' GROUP BY token
""")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frequencies(_documents(spark, sf_dir), "body", DOCUMENT_DELIMITERS)


@query("token_summary", DOCUMENT_TOKENS + """
, per_doc AS (SELECT d.doc_id, count(token) FILTER (token <> '') AS n,
    coalesce(string_agg(token, ',' ORDER BY place) FILTER (token <> ''), '') AS joined
  FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id GROUP BY d.doc_id)
SELECT min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 4) AS mean_tokens,
  count(*) FILTER (n > 0) AS non_empty_rows, count(DISTINCT joined) AS distinct_sequences FROM per_doc
""")
def token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count_summary(_document_tokens(spark, sf_dir))


@query("bracketed_documents")
def bracketed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their brackets kept: tokens per document."""

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_tokens(documents, "text", DOCUMENT_DELIMITERS).select(
        "doc_id", F.size("tokens").alias("token_count"))


@query("value_distribution", """
SELECT event_type AS value, count(*) AS value_count FROM events GROUP BY event_type
""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "events"), "event_type")


@query("top_sequences", """
SELECT replace(lower(p_name), ' ', ',') AS sequence, count(*) AS sequence_count
FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def top_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_sequences(with_tokens(table(spark, sf_dir, "part"), "p_name", [" "]))


@query("dataset_profile", PART_SEQUENCE + """
, toks AS (SELECT unnest(string_split(p_name, ' ')) AS token FROM part),
top AS (SELECT replace(p_name, ' ', ',') AS sequence, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10)
SELECT 'label_distribution' AS section, p_type AS item, count(*)::VARCHAR AS value FROM part GROUP BY p_type
UNION ALL SELECT 'length_distribution', p_size::VARCHAR, count(*)::VARCHAR FROM part GROUP BY p_size
UNION ALL SELECT 'token_frequencies', token, count(*)::VARCHAR FROM toks GROUP BY token
UNION ALL SELECT 'top_sequences', sequence, n::VARCHAR FROM top
UNION ALL SELECT 'token_counts', 'min_tokens', '2'
UNION ALL SELECT 'token_counts', 'max_tokens', '2'
UNION ALL SELECT 'token_counts', 'mean_tokens', '2.0'
UNION ALL SELECT 'token_counts', 'non_empty_rows', count(*)::VARCHAR FROM part
UNION ALL SELECT 'token_counts', 'distinct_sequences', count(DISTINCT p_name)::VARCHAR FROM part
UNION ALL SELECT 'constant_columns:priced', 'fixed', count(*)::VARCHAR FROM part
""")
def part_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    priced = part.select("p_partkey", "p_retailprice", F.lit(1).alias("fixed"))
    return dataset_profile(part, label="p_type", length="p_size", sequence="p_name", delimiters=[" "],
                           feature_tables={"priced": priced}, not_features=["p_partkey"])


def _with_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({
        "fixed": F.lit(7), "empty": F.lit(None).cast("double"),
        "not_a_number": F.lit(float("nan")),
        "fixed_or_missing": F.when(F.col("l_quantity") > 10, F.lit("x"))})


@query("zero_variance", """
SELECT *, n AS row_count FROM (VALUES ('l_discount', false), ('l_returnflag', false), ('l_shipdate', false),
  ('fixed', true), ('empty', true), ('not_a_number', true), ('fixed_or_missing', false)) t("column", is_constant),
  (SELECT count(*) AS n FROM lineitem)
""".replace("SELECT *, n AS", "SELECT \"column\", is_constant, n AS"))
def zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant_columns(_with_constants(spark, sf_dir), [
        "l_discount", "l_returnflag", "l_shipdate", "fixed", "empty", "not_a_number",
        "fixed_or_missing"])


@query("feature_report", """
SELECT 'raw' AS table_name, count(*) AS row_count, 2 AS feature_column_count, 'fixed' AS constant_columns FROM lineitem
UNION ALL SELECT 'wide', count(*), 4, 'fixed,empty' FROM lineitem
""")
def feature_tables_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_constants(spark, sf_dir)
    tables = {"raw": rows.select("l_orderkey", "l_tax", "fixed"),
              "wide": rows.select("l_orderkey", "l_tax", "fixed", "l_discount", "empty")}
    return feature_report(tables, ["l_orderkey"]).withColumn(
        "constant_columns", F.array_join("constant_columns", ","))


@query("histogram_30", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
w AS (SELECT lo, (hi - lo) / 30 AS width FROM b),
h AS (SELECT least(floor((o_totalprice - lo) / width)::INT, 29) AS bin, lo, width FROM orders, w)
SELECT bin, round(lo + bin * width, 6) AS bin_start, round(lo + (bin + 1) * width, 6) AS bin_end,
  count(*) AS bin_count FROM h GROUP BY bin, lo, width
""")
def histogram_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histogram(table(spark, sf_dir, "orders"), "o_totalprice"), "bin_start", "bin_end")


@query("column_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"count(DISTINCT {c}) AS distinct_count, '{t}' AS data_type FROM customer"
    for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def customer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(table(spark, sf_dir, "customer"))


def _documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCUMENTS_LABELS = "WITH t AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))\n"


@query("missing_by_column", DOCUMENTS_LABELS + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM t"
    for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")))
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_by_column(_documents_with_labels(spark, sf_dir))


@query("columns_with_missing", DOCUMENTS_LABELS + """
SELECT 'quality' AS "column", count(*) - count(quality) AS missing_count FROM t
UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM t
""")
def columns_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_by_column(_documents_with_labels(spark, sf_dir), 15, only_missing=True)


@query("overview", DOCUMENTS_LABELS + """
SELECT 'size' AS section, 'row_count' AS item, count(*) AS value FROM t
UNION ALL SELECT 'size', 'column_count', 7
""" + "".join(f"UNION ALL SELECT 'missing_top_20', '{c}', count(*) - count({c}) FROM t\n"
              for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")) + """
UNION ALL SELECT 'label_top_20', quality::VARCHAR, count(*) FROM t GROUP BY quality
UNION ALL SELECT 'length_distribution', lang, count(*) FROM t GROUP BY lang
""")
def documents_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(_documents_with_labels(spark, sf_dir), "quality", "lang")


@query("duplicate_keys", """
SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem
""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("describe", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c})::DOUBLE AS value_count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
  round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max
FROM customer""" for c in ("c_acctbal", "c_nationkey::DOUBLE")).replace("'c_nationkey::DOUBLE'", "'c_nationkey'"))
def describe_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], round_to=4)


# -- targets ----------------------------------------------------------------------------------

@query("target_join", """
SELECT doc_id, quality, toxic, n_chars::DOUBLE AS size_target FROM labels JOIN documents USING (doc_id)
""")
def target_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").alias("size_target"))
    return join_target(table(spark, sf_dir, "labels"), targets, id_column="doc_id",
                       target="size_target")


@query("target_design", """
SELECT doc_id, quality, toxic, n_chars::DOUBLE AS size_target FROM labels JOIN documents USING (doc_id)
""")
def target_design_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "labels").withColumn("fixed", F.lit(1))
    targets = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").alias("size_target"))
    return target_design(features, targets, id_column="doc_id", target="size_target",
                         allowed=["quality", "fixed", "toxic", "absent"])


@query("target_profile", GROUPED_ORDERS + """
, t AS (SELECT o_totalprice / 1000 AS amount, o_totalprice / 2000 AS half FROM orders JOIN s USING (o_custkey))
SELECT 'amount' AS target, count(*) AS row_count, round(min(amount), 6) AS target_min,
  round(max(amount), 6) AS target_max, round(avg(amount), 6) AS target_mean,
  round(quantile_cont(amount, 0.5), 6) AS target_median FROM t
""")
def target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey").withColumn(
        "amount", F.col("o_totalprice") / 1000)
    return rounded(target_summary(split, ["amount"]), "target_min", "target_max", "target_mean",
                   "target_median")


# -- policies ---------------------------------------------------------------------------------

@query("feature_policy", """
SELECT * FROM (VALUES
  ('l_orderkey', 'id', NULL, false, false), ('l_partkey', 'allowed', NULL, false, true),
  ('l_suppkey', 'other', NULL, false, false), ('l_linenumber', 'other', NULL, false, false),
  ('l_quantity', 'allowed', NULL, false, true),
  ('l_extendedprice', 'forbidden', 'derived from the outcome', false, false),
  ('l_discount', 'allowed', NULL, false, true), ('l_tax', 'other', NULL, false, false),
  ('l_returnflag', 'label', NULL, false, false), ('l_linestatus', 'other', NULL, false, false),
  ('l_shipdate', 'forbidden', 'known only afterwards', false, false),
  ('fixed', 'allowed', NULL, true, false), ('absent', 'missing', NULL, false, false)
) t("column", role, reason, dropped_as_constant, is_used)
""")
def feature_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit(7))
    return policy_audit(
        rows, allowed=["l_partkey", "l_quantity", "l_discount", "fixed", "absent"],
        forbidden={"l_extendedprice": "derived from the outcome",
                   "l_shipdate": "known only afterwards"},
        roles={"l_orderkey": "id", "l_returnflag": "label"})


@query("classification_inputs", """
SELECT l_orderkey, l_returnflag, l_quantity, l_tax FROM lineitem
""")
def classification_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", F.lit(1).alias("fixed"))
    return classification_design(rows, id_column="l_orderkey", label="l_returnflag",
                                 excluded=["l_discount"])


@query("regression_inputs", """
SELECT o_orderkey, o_totalprice, o_custkey FROM orders
""")
def regression_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast("string").alias("o_totalprice"), F.lit(1).alias("fixed"))
    return regression_design(rows, id_column="o_orderkey", target="o_totalprice",
                             label="o_orderstatus", outcome_columns=["o_orderpriority"],
                             candidates=["o_custkey", "o_orderpriority", "fixed"])


@query("project_roles", GROUPED_ORDERS + """
SELECT split_name, o_custkey::VARCHAR AS o_custkey, o_orderkey, o_totalprice, o_orderpriority
FROM orders JOIN s USING (o_custkey)
""")
def project_split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # "late" varies only outside train, so it must go
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey")
    late = F.when(F.col("split_name") == "train", F.lit(0)).otherwise(F.col("o_orderkey"))
    return fixed_split_design(
        split.withColumn("late", late), target="o_totalprice",
        features=["o_orderpriority", "late"], group="o_custkey", keep=["o_orderkey"])


@query("strict_split_design", GROUPED_ORDERS + """
SELECT split_name, o_custkey::VARCHAR AS o_custkey, o_totalprice::VARCHAR::DOUBLE AS price, o_orderstatus
FROM orders JOIN s USING (o_custkey)
""")
def strict_split_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target given as text, which the strict design reads or stops at; a column constant in train goes."""

    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey").withColumns({
        "price": F.col("o_totalprice").cast("string"), "fixed": F.lit("x")})
    return fixed_split_design(split, target="price", features=["o_orderstatus", "fixed"], group="o_custkey", strict=True)


@query("role_projection", """
SELECT o_orderpriority, o_totalprice, o_orderkey, o_custkey, o_orderdate FROM (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
  FROM orders)
""")
def role_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    roles = project_roles(orders, features=["o_orderpriority", "absent"],
                          targets=["o_totalprice"], target="o_totalprice", group="o_custkey",
                          payload=["o_orderstatus"])
    return select_roles(orders, roles)


# -- split profiles ---------------------------------------------------------------------------

@query("split_profile", GROUPED_ORDERS + """
SELECT split_name, count(*) AS row_count, count(DISTINCT o_custkey) AS group_count,
  round(avg(o_totalprice), 4) AS target_mean, min(o_totalprice) AS target_min, max(o_totalprice) AS target_max
FROM orders JOIN s USING (o_custkey) GROUP BY split_name
""")
def split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey")
    return rounded(split_overview(split, "o_custkey", target="o_totalprice"), "target_mean", digits=4)


@query("split_variants", "WITH " + split_cte("lineitem", "l_orderkey") + """
SELECT split_name, l_returnflag, count(*) AS row_count
FROM lineitem JOIN s USING (l_orderkey) GROUP BY ALL
""")
def split_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_counts(split_groups(table(spark, sf_dir, "lineitem"), "l_orderkey"), "l_returnflag")


@query("category_chart", "\nUNION ALL ".join(
    f"SELECT '{c}' AS chart, {c} AS value, count(*) AS value_count FROM orders GROUP BY {c}"
    for c in ("o_orderstatus", "o_orderpriority")))
def category_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    charts = [value_counts(orders, c).select(F.lit(c).alias("chart"), "value", "value_count")
              for c in ("o_orderstatus", "o_orderpriority")]
    return reduce(lambda a, b: a.unionByName(b), charts)
