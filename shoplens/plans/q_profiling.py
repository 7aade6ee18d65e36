"""Profiling queries over the product dimension and the raw tables."""

from __future__ import annotations

from shoplens.operators import profiling as PR
from shoplens.operators.catalog import DIMENSION_COLUMNS
from shoplens.plans import sqlparts as Q
from shoplens.plans.q_catalog import dimension
from shoplens.plans.registry import register
from shoplens.sources import tables as T

_DIM = f"WITH {Q.PRODUCT_DIM_CTE}"
_NUMERIC = ["price", "stars", "reviews", "boughtInLastMonth"]


def _nulls_sql() -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS n FROM dim"
             for c in DIMENSION_COLUMNS]
    return f"""{_DIM}, u AS ({' UNION ALL '.join(parts)})
SELECT column_name, nulls, CASE WHEN n > 0 THEN {Q.rhu('100.0::DOUBLE * nulls / n', 2)} END AS null_pct FROM u"""


@register("column_nulls", _nulls_sql())
def q_column_nulls(spark, sf_dir):
    """EDA2: nulls per column of the product dimension."""
    return PR.null_counts(dimension(spark, sf_dir))


def _describe_sql() -> str:
    r = lambda e: Q.rhu(e, 6)
    parts = [f"""SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({c})')} AS mean,
  {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
  {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
  {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS max FROM dim""" for c in _NUMERIC]
    return f"{_DIM} {' UNION ALL '.join(parts)}"


@register("describe_numeric", _describe_sql())
def q_describe_numeric(spark, sf_dir):
    """EDA3: describe() of the numeric dimension columns, exact quantiles."""
    return PR.describe(dimension(spark, sf_dir), _NUMERIC)


@register("distinct_counts", f"""{_DIM}
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM dim"
                    for c in DIMENSION_COLUMNS)}""")
def q_distinct_counts(spark, sf_dir):
    """EDA4."""
    return PR.distinct_counts(dimension(spark, sf_dir))


@register("missing_summary", f"""{_DIM},
u AS ({' UNION ALL '.join(f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM dim"
                          for c in DIMENSION_COLUMNS)})
SELECT {Q.rhu(f'100.0::DOUBLE * sum(nulls) / ({len(DIMENSION_COLUMNS)} * (SELECT count(*) FROM dim))', 2)}
         AS missing_pct,
       4 AS dtype_kinds, {len(DIMENSION_COLUMNS)} AS columns, (SELECT count(*) FROM dim) AS rows
FROM u""")
def q_missing_summary(spark, sf_dir):
    """EDA6: overall missing %, dtype variety (string, double, int and boolean
    in the dimension), size."""
    return PR.missing_summary(dimension(spark, sf_dir))


@register("top_values", f"""{_DIM},
t AS (SELECT 'category' AS column_name, category AS value, count(*) AS count FROM dim
      WHERE category IS NOT NULL GROUP BY 2 ORDER BY count DESC, value ASC LIMIT 3),
u AS (SELECT 'title' AS column_name, title AS value, count(*) AS count FROM dim
      WHERE title IS NOT NULL GROUP BY 2 ORDER BY count DESC, value ASC LIMIT 3),
v AS (SELECT 'product_id' AS column_name, product_id AS value, count(*) AS count FROM dim
      WHERE product_id IS NOT NULL GROUP BY 2 ORDER BY count DESC, value ASC LIMIT 3)
SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM v""")
def q_top_values(spark, sf_dir):
    """TOP4: top-3 values of category, title and product id."""
    return PR.top_values(dimension(spark, sf_dir), ["category", "title", "product_id"], 3)


@register("head_rows", f"""{_DIM} SELECT * FROM dim ORDER BY product_id LIMIT 5""")
def q_head_rows(spark, sf_dir):
    """TOP5: head(5) in product id order."""
    return PR.head(dimension(spark, sf_dir), "product_id", 5)


@register("duplicate_rows", """
SELECT (SELECT count(*) FROM part) - count(*) AS duplicate_rows, (SELECT count(*) FROM part) AS rows
FROM (SELECT DISTINCT * FROM part)""")
def q_duplicate_rows(spark, sf_dir):
    """SET3: duplicate whole rows of the part table."""
    return PR.duplicate_rows(T.read_table(spark, sf_dir, "part"))


@register("key_overlap", """
WITH k AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events
           WHERE json_extract_string(props, '$.k') IS NOT NULL),
m AS (SELECT count(*) AS matched FROM k WHERE k IN (SELECT CAST(p_partkey AS VARCHAR) FROM part))
SELECT (SELECT count(*) FROM k) AS keys, matched,
       CASE WHEN (SELECT count(*) FROM k) > 0
            THEN floor(100.0::DOUBLE * matched / (SELECT count(*) FROM k) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE
       END AS match_pct
FROM m""")
def q_key_overlap(spark, sf_dir):
    """JN7: how many event product keys exist in the catalogue."""
    ev = T.actions(spark, sf_dir)
    part = T.read_table(spark, sf_dir, "part", ["p_partkey"])
    return PR.key_overlap(ev, "product_id", part, "p_partkey")


_TYPES = {"product_id": "string", "title": "string", "price": "double", "stars": "double", "reviews": "int",
          "isBestSeller": "boolean", "boughtInLastMonth": "int", "category": "string"}


@register("schema_summary", f"""{_DIM},
c(position, column_name, dtype) AS (VALUES {', '.join(f"({i}, '{c}', '{_TYPES[c]}')"
                                                      for i, c in enumerate(DIMENSION_COLUMNS))})
SELECT position, column_name, dtype, (SELECT count(*) FROM dim) AS rows FROM c""")
def q_schema_summary(spark, sf_dir):
    """EDA1: columns, types and row count of the product dimension."""
    return PR.schema_summary(dimension(spark, sf_dir))


@register("sample_rows", """
SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 100""")
def q_sample_rows(spark, sf_dir):
    """EDA5: a repeatable exact 100-row sample of the orders table (seed 42)."""
    orders = T.read_table(spark, sf_dir, "orders")
    return PR.sample_exact(orders, 100, "o_orderkey", 42)


_PAIRS = [("orders", "lineitem"), ("documents", "labels"), ("customer", "nation"), ("events", "orders")]


@register("shared_columns", f"""WITH p(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PAIRS)}),
c AS (SELECT table_name, column_name FROM duckdb_columns() WHERE NOT internal),
s AS (SELECT p.a, p.b, x.column_name FROM p JOIN c x ON x.table_name = p.a JOIN c y ON y.table_name = p.b AND y.column_name = x.column_name)
SELECT p.a AS left_table, p.b AS right_table, count(s.column_name) AS shared,
  coalesce(string_agg(s.column_name, ',' ORDER BY s.column_name), '') AS columns
FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b GROUP BY ALL""")
def q_shared_columns(spark, sf_dir):
    """SET4: column names that pairs of the given tables share."""
    rows = []
    for a, b in _PAIRS:
        shared = PR.column_overlap(T.read_table(spark, sf_dir, a), T.read_table(spark, sf_dir, b))["shared"]
        rows.append((a, b, len(shared), ",".join(shared)))
    return spark.createDataFrame(rows, "left_table string, right_table string, shared long, columns string")
