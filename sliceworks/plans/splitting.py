"""Queries on splits, folds, samples and split audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceworks.operators.audit import audit_splits, group_overlaps, split_checks
from sliceworks.operators.ordering import exact_quantiles
from sliceworks.operators.splits import (
    grouped_folds, sample_groups, sample_rows, split_groups, split_membership, split_rows,
    split_stratified, split_summary, with_folds,
)
from sliceworks.plans.registry import query, rounded, table
from sliceworks.plans.sql import GROUPED_ORDERS, split_cte

PLAIN_ORDERS = "WITH " + split_cte("orders", "o_orderkey")

# Quotas by largest remainder, first for test, then for validation among the rest.
STRATIFIED_LABELS = """
WITH c AS (SELECT quality::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS total, ceil(sum(n) * 0.05::DOUBLE)::BIGINT AS n_test FROM c),
v AS (SELECT *, ceil((total - n_test) * (0.15::DOUBLE / (1.0::DOUBLE - 0.05::DOUBLE)))::BIGINT AS n_val FROM t),
q1 AS (SELECT label, n, n_test, n_val, total, n_test * n // total AS base,
    row_number() OVER (ORDER BY n_test * n % total DESC, label) AS place FROM c, v),
q2 AS (SELECT *, base + (place <= n_test - sum(base) OVER ())::BIGINT AS k_test FROM q1),
q3 AS (SELECT *, n - k_test AS rest FROM q2),
q4 AS (SELECT *, n_val * rest // (total - n_test) AS base2,
    row_number() OVER (ORDER BY n_val * rest % (total - n_test) DESC, label) AS place2 FROM q3),
quota AS (SELECT label, k_test, base2 + (place2 <= n_val - sum(base2) OVER ())::BIGINT AS k_val FROM q4),
ranked AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id::VARCHAR)) AS rn FROM labels),
split AS (SELECT doc_id, quality, CASE WHEN rn <= k_test THEN 'test' WHEN rn <= k_test + k_val THEN 'validation'
    ELSE 'train' END AS split_name FROM ranked JOIN quota ON quality::VARCHAR = label)
"""


@query("stratified_split", STRATIFIED_LABELS + "SELECT doc_id, quality, split_name FROM split")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_stratified(table(spark, sf_dir, "labels"), ["doc_id"], "quality").select(
        "doc_id", "quality", "split_name")


@query("stratified_split_summary", STRATIFIED_LABELS + """
SELECT split_name, quality, count(*) AS row_count, sum(count(*)) OVER (PARTITION BY split_name)::BIGINT AS split_rows,
  round(sum(count(*)) OVER (PARTITION BY split_name) / sum(count(*)) OVER (), 6) AS split_fraction,
  sum(count(*)) OVER ()::BIGINT AS total_rows FROM split GROUP BY split_name, quality
""")
def stratified_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_stratified(table(spark, sf_dir, "labels"), ["doc_id"], "quality")
    return split_summary(split, "quality")


@query("unstratified_fallback", "WITH " + split_cte("orders", "o_orderkey") + """
SELECT o_orderkey, split_name FROM s
""")
def unstratified_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row has a label of its own, so the label mix cannot be kept
    orders = table(spark, sf_dir, "orders").withColumn(
        "label", F.when(F.col("o_orderkey") == 0, "single").otherwise(F.col("o_orderstatus")))
    return split_stratified(orders, ["o_orderkey"], "label").select("o_orderkey", "split_name")


@query("plain_split", PLAIN_ORDERS + "SELECT o_orderkey, split_name FROM s")
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(table(spark, sf_dir, "orders"), ["o_orderkey"]).select(
        "o_orderkey", "split_name")


@query("plain_split_summary", PLAIN_ORDERS + """
SELECT split_name, count(*) AS row_count, count(*) AS split_rows,
  round(count(*) / sum(count(*)) OVER (), 6) AS split_fraction, sum(count(*)) OVER ()::BIGINT AS total_rows
FROM s GROUP BY split_name
""")
def plain_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_summary(split_rows(table(spark, sf_dir, "orders"), ["o_orderkey"]))


@query("grouped_split", GROUPED_ORDERS + """
SELECT split_name, o_custkey, o_orderkey FROM orders JOIN s USING (o_custkey)
""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey")
    return split_membership(split, "o_custkey", ["o_orderkey"])


@query("grouped_split_turns", "WITH " + split_cte("conversations", "conv_id") + """
SELECT split_name, conv_id, turn FROM conversations JOIN s USING (conv_id)
""")
def grouped_split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "conversations"), "conv_id")
    return split_membership(split, "conv_id", ["turn"])


def folds_sql(table_name: str, group: str, folds: int) -> str:
    """Deal the groups one after the other to the lightest fold, by a fold over a list."""

    start = ", ".join(["0::BIGINT"] * folds)
    return f"""WITH sizes AS (SELECT {group}, count(*) AS group_rows FROM {table_name} GROUP BY {group}),
ordered AS (SELECT *, row_number() OVER (ORDER BY group_rows DESC, md5('42|' || {group}::VARCHAR)) AS rn FROM sizes),
listed AS (SELECT list(group_rows ORDER BY rn) AS item FROM ordered),
dealt AS (
  SELECT list_reduce(item, lambda a, x: {{
      'loads': list_transform(a.loads, lambda load, i: load + CASE WHEN i = list_position(a.loads, list_min(a.loads)) THEN x.x ELSE 0 END),
      'x': 0::BIGINT, 'picks': list_append(a.picks, list_position(a.loads, list_min(a.loads)) - 1)}},
    {{'loads': [{start}], 'x': 0::BIGINT, 'picks': []::INT[]}}).picks AS picks
  FROM (SELECT list_transform(item, lambda v: {{'loads': []::BIGINT[], 'x': v, 'picks': []::INT[]}}) AS item FROM listed))
SELECT {group}, group_rows, picks[rn]::INT AS fold FROM ordered, dealt"""


def stratified_sql(rows: str, group: str, folds: int) -> str:
    """Deal the groups of ``rows`` (with a ``label``), the most uneven first, each to the fold that leaves the
    labels' shares least spread."""

    deviation = "sqrt(({folds} * {two} - ({one}) * ({one}))::DOUBLE) / ({folds} * t[k])"
    one = "list_sum(list_transform(counts, lambda c: c[k]))"
    two = "list_sum(list_transform(counts, lambda c: c[k] * c[k]))"
    new = deviation.format(folds=folds, one=f"{one} + v[k]", two=f"({two} + 2 * v[k] * counts[f][k] + v[k] * v[k])")
    old = deviation.format(folds=folds, one=one, two=two)
    return f"""WITH RECURSIVE c AS ({rows}),
lab AS (SELECT {group}, label, count(*) AS n FROM c GROUP BY ALL),
tot AS (SELECT label, sum(n)::BIGINT AS t FROM lab GROUP BY label),
tots AS (SELECT list(t ORDER BY label NULLS FIRST) AS t, count(*) AS labels FROM tot),
wide AS (SELECT g.{group}, tot.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT {group} FROM lab) g CROSS JOIN tot
    LEFT JOIN lab ON lab.{group} = g.{group} AND lab.label IS NOT DISTINCT FROM tot.label),
grp AS (SELECT {group}, sum(n)::BIGINT AS group_rows, sum(n * n)::BIGINT AS squares, list(n ORDER BY label NULLS FIRST) AS v,
    string_agg(to_json([label])::VARCHAR || n, '' ORDER BY label NULLS FIRST) FILTER (WHERE n > 0) AS class,
    list(label ORDER BY -n, label IS NULL, label)[1] AS majority_label FROM wide GROUP BY {group}),
ordered AS (SELECT *, row_number() OVER (ORDER BY squares * labels - group_rows * group_rows DESC, group_rows DESC, class,
    md5('42|' || {group}::VARCHAR)) AS rn FROM grp, tots),
deal AS (
  SELECT 0::BIGINT AS rn, list_transform(range({folds}), lambda f: list_transform(t, lambda x: 0::BIGINT)) AS counts, 0 AS fold FROM tots
  UNION ALL
  SELECT rn, list_transform(counts, lambda c, f: CASE WHEN f = best THEN list_transform(c, lambda x, k: x + v[k]) ELSE c END), best - 1
  FROM (SELECT o.rn, v, counts, list_min(list_transform(range(1, {folds + 1}), lambda f: {{
        'change': round(list_sum(list_transform(range(1, labels + 1), lambda k: {new} - {old})), 10),
        'load': list_sum(counts[f]), 'f': f}})).f AS best
    FROM deal JOIN ordered o ON o.rn = deal.rn + 1))
SELECT {group}, group_rows, majority_label, fold::INT AS fold FROM ordered JOIN deal USING (rn)"""


@query("grouped_folds", folds_sql("lineitem", "l_orderkey", 3))
def lineitem_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_folds(table(spark, sf_dir, "lineitem"), "l_orderkey", 3)


@query("stratified_folds", stratified_sql(
    "SELECT conv_id, CASE WHEN role <> 'system' AND turn % 7 <> 3 THEN role END AS label FROM conversations",
    "conv_id", 4))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of conversations that balance their roles; some roles are taken out, so null is a label."""

    rows = table(spark, sf_dir, "conversations").withColumn("label", F.expr(
        "CASE WHEN role <> 'system' AND turn % 7 <> 3 THEN role END"))
    return grouped_folds(rows, "conv_id", 4, label="label")


@query("fold_sizes", "SELECT fold, sum(group_rows)::BIGINT AS row_count, count(*) AS group_count FROM ("
       + folds_sql("orders", "o_custkey", 5) + ") GROUP BY fold")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_folds(table(spark, sf_dir, "orders"), "o_custkey", 5)
    per_group = rows.groupBy("fold", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy("fold").agg(F.sum("n").alias("row_count"),
                                         F.count(F.lit(1)).alias("group_count"))


# -- samples ----------------------------------------------------------------------------------

@query("grouped_sample", GROUPED_ORDERS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY split_name ORDER BY md5('42|' || o_custkey::VARCHAR)) AS rn FROM s)
SELECT split_name, o_custkey, o_orderkey FROM orders JOIN r USING (o_custkey)
WHERE rn <= CASE split_name WHEN 'train' THEN 200 WHEN 'validation' THEN 25 ELSE 25 END
""")
def grouped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey")
    sample = sample_groups(split, "o_custkey", {"train": 200, "validation": 25, "test": 25})
    return sample.select("split_name", "o_custkey", "o_orderkey")


@query("bounded_sample", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey::VARCHAR) LIMIT 500
""")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 500, seed=7).select(
        "o_orderkey", "o_totalprice")


@query("exact_quantiles", """
SELECT p, round(quantile_cont(l_extendedprice, p), 4) AS value FROM lineitem,
  (VALUES (0.01), (0.1), (0.5), (0.9), (0.99)) t(p) GROUP BY p
""".replace("quantile_cont(l_extendedprice, p)", """CASE p WHEN 0.01 THEN quantile_cont(l_extendedprice, 0.01)
  WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
  WHEN 0.9 THEN quantile_cont(l_extendedprice, 0.9) ELSE quantile_cont(l_extendedprice, 0.99) END"""))
def narrowed_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles through the narrowing passes that large tables take."""

    probabilities = [0.01, 0.1, 0.5, 0.9, 0.99]
    values = exact_quantiles(table(spark, sf_dir, "lineitem"), {"l_extendedprice": probabilities},
                             limit=5000)["l_extendedprice"]
    rows = spark.createDataFrame(list(zip(probabilities, values, strict=True)), "p double, value double")
    return rounded(rows, "value", digits=4)


# -- audits -----------------------------------------------------------------------------------

def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])


AUDIT = """
SELECT split_name, count(*) AS row_count, count(DISTINCT o_custkey) AS group_count,
  count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS duplicate_rows
FROM rows GROUP BY split_name
"""


@query("split_audit", GROUPED_ORDERS + ", rows AS (SELECT * FROM orders JOIN s USING (o_custkey))" + AUDIT)
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_groups(table(spark, sf_dir, "orders"), "o_custkey")
    return audit_splits(split, "o_custkey", ["o_custkey", "o_orderstatus"]).counts


@query("split_audit_leaky", PLAIN_ORDERS + ", rows AS (SELECT * FROM orders JOIN s USING (o_orderkey))" + AUDIT)
def split_audit_leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_splits(_leaky(spark, sf_dir), "o_custkey", ["o_custkey", "o_orderstatus"]).counts


OVERLAPS = """
, g AS (SELECT DISTINCT o_custkey::VARCHAR AS group_value, split_name FROM rows)
SELECT a.split_name AS left_split, b.split_name AS right_split, group_value
FROM g a JOIN g b USING (group_value)
WHERE (a.split_name, b.split_name) IN (('train', 'validation'), ('train', 'test'), ('validation', 'test'))
"""


@query("split_overlap", PLAIN_ORDERS + ", rows AS (SELECT * FROM orders JOIN s USING (o_orderkey))" + OVERLAPS)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_overlaps(_leaky(spark, sf_dir), "o_custkey")


@query("split_overlap_without_nulls", PLAIN_ORDERS + """
, rows AS (SELECT nullif(o_orderstatus, 'F') AS o_custkey, split_name FROM orders JOIN s USING (o_orderkey)
  WHERE o_orderstatus <> 'F')""" + OVERLAPS)
def split_overlap_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leaky(spark, sf_dir).withColumn("status", F.expr("nullif(o_orderstatus, 'F')"))
    return group_overlaps(rows, "status", nulls=False)


@query("split_checks", GROUPED_ORDERS + """
, rows AS (SELECT split_name, o_totalprice / 500000 AS share, o_totalprice / 200000 AS ratio,
    NULL::DOUBLE AS optional FROM orders JOIN s USING (o_custkey))
SELECT split_name, 'target_range' AS check_name, 'share' AS "column",
  count(*) FILTER (share < 0 OR share > 1) = 0 AS passed, count(*) FILTER (share < 0 OR share > 1) AS measure
FROM rows GROUP BY split_name
UNION ALL SELECT split_name, 'target_range', 'ratio', count(*) FILTER (ratio < 0 OR ratio > 1) = 0,
  count(*) FILTER (ratio < 0 OR ratio > 1) FROM rows GROUP BY split_name
UNION ALL SELECT split_name, 'target_range', 'optional', true, 0 FROM rows GROUP BY split_name
UNION ALL SELECT split_name, 'target_varies', 'share', var_samp(share) > 0, count(*) FROM rows WHERE split_name = 'train' GROUP BY split_name
UNION ALL SELECT split_name, 'feature_filled', 'optional', false, 0 FROM rows WHERE split_name = 'train' GROUP BY split_name
UNION ALL SELECT split_name, 'feature_filled', 'ratio', true, count(*) FROM rows WHERE split_name = 'train' GROUP BY split_name
""")
def split_check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_groups(table(spark, sf_dir, "orders"), "o_custkey").withColumns({
        "share": F.col("o_totalprice") / 500000, "ratio": F.col("o_totalprice") / 200000,
        "optional": F.lit(None).cast("double")})
    return split_checks(rows, targets=["share", "ratio", "optional"], features=["optional", "ratio"],
                        optional_targets=["optional"], varying_target="share")
