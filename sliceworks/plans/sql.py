"""SQL fragments (DuckDB dialect) that several oracles share."""

from __future__ import annotations


def split_cte(table: str, key: str, *, name: str = "s", seed: int = 42) -> str:
    """Distinct keys of a table with their split: 5% test and 15% validation in md5 order."""

    return f"""
{name}_keys AS (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || {key}::VARCHAR)) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table})),
{name}_cuts AS (SELECT *, ceil(n * 0.05::DOUBLE) AS n_test FROM {name}_keys),
{name} AS (SELECT {key}, CASE WHEN rn <= n_test THEN 'test'
    WHEN rn <= n_test + ceil((n - n_test) * (0.15::DOUBLE / (1.0::DOUBLE - 0.05::DOUBLE))) THEN 'validation'
    ELSE 'train' END AS split_name FROM {name}_cuts)
"""


GROUPED_ORDERS = "WITH " + split_cte("orders", "o_custkey")

PART_BITS = """
WITH rows AS (
  SELECT p_partkey, CASE WHEN p_size = 1 THEN p_brand WHEN p_size = 2 THEN '' WHEN p_size = 3 THEN NULL
    ELSE bin(p_partkey) END AS bits, p_partkey % 9 + p_size % 5 AS width FROM part),
judged AS (
  SELECT *, CASE WHEN bits IS NULL THEN 'missing_bitstring' WHEN bits = '' THEN 'empty_bitstring'
    WHEN width <= 0 THEN 'invalid_width'
    WHEN NOT regexp_full_match(bits, '[01]+') THEN 'non_binary_bitstring'
    WHEN length(bits) > width THEN 'bitstring_longer_than_width' END AS issue FROM rows)
"""

# What the bracketed and quoted sequences of the token queries must parse to.
PART_SEQUENCE = """
WITH seq AS (
  SELECT *, list_concat([lower(p_type)], string_split(p_name, ' ')) AS tokens FROM part)
"""

# Orders with customer data, split by customer, and two models in two regimes scored on the
# held-out splits. Amounts are in thousands.
PREDICTIONS = GROUPED_ORDERS + """
, base AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, c.c_mktsegment,
    o.o_totalprice / 1000 AS amount, s.split_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN s ON s.o_custkey = o.o_custkey),
edges AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b,
    quantile_cont(amount, 0.75) AS c FROM base WHERE split_name = 'train'),
held AS (SELECT base.*, CASE WHEN amount <= a THEN 'q1' WHEN amount <= b THEN 'q2'
    WHEN amount <= c THEN 'q3' ELSE 'q4' END AS difficulty_bucket
  FROM base, edges WHERE split_name <> 'train'),
m0 AS (SELECT avg(amount) AS m FROM base WHERE split_name = 'train'),
m1 AS (SELECT o_orderpriority, avg(amount) AS m FROM base WHERE split_name = 'train' GROUP BY 1),
m2 AS (SELECT o_orderpriority, c_mktsegment, avg(amount) AS m FROM base WHERE split_name = 'train' GROUP BY 1, 2),
scored AS (
  SELECT held.*, 'plain' AS ablation_name, 'dummy_mean' AS model_name, m AS predicted_value FROM held, m0
  UNION ALL SELECT held.*, 'plain', 'group_mean', m FROM held JOIN m1 USING (o_orderpriority)
  UNION ALL SELECT held.*, 'with_segment', 'dummy_mean', m FROM held, m0
  UNION ALL SELECT held.*, 'with_segment', 'group_mean', m FROM held JOIN m2 USING (o_orderpriority, c_mktsegment)),
pred AS (SELECT *, amount AS target_value, predicted_value - amount AS residual,
    abs(predicted_value - amount) AS absolute_error,
    (predicted_value - amount) * (predicted_value - amount) AS squared_error FROM scored)
"""

MEASURES = """count(*) AS sample_count, avg(absolute_error) AS mae, sqrt(sum(squared_error) / count(*)) AS rmse,
    CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(target_value) > 0
      THEN 1 - sum(squared_error) / (var_pop(target_value) * count(*))
      WHEN sum(squared_error) = 0 THEN 1 ELSE 0 END AS r2"""

SLICE_COLUMNS = ("c_mktsegment", "o_orderpriority", "o_orderstatus", "difficulty_bucket")

SLICES = PREDICTIONS + f"""
, sliced AS (
  SELECT split_name, ablation_name, model_name, 'overall' AS slice_name, 'overall' AS slice_value,
    {MEASURES} FROM pred GROUP BY ALL
""" + "".join(f"""
  UNION ALL SELECT split_name, ablation_name, model_name, '{c}', {c}, {MEASURES} FROM pred GROUP BY ALL
""" for c in SLICE_COLUMNS) + ")"

# One row per regime and model with validation and test columns.
SUMMARY = SLICES + """
, summary AS (
  SELECT ablation_name, model_name,
    max(CASE WHEN split_name = 'validation' THEN mae END) AS validation_mae,
    max(CASE WHEN split_name = 'validation' THEN rmse END) AS validation_rmse,
    max(CASE WHEN split_name = 'validation' THEN r2 END) AS validation_r2,
    max(CASE WHEN split_name = 'test' THEN mae END) AS test_mae,
    max(CASE WHEN split_name = 'test' THEN rmse END) AS test_rmse,
    max(CASE WHEN split_name = 'test' THEN r2 END) AS test_r2
  FROM sliced WHERE slice_name = 'overall' GROUP BY ALL)
"""
