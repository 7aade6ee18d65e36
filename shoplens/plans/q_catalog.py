"""Catalogue and trending queries."""

from __future__ import annotations

from shoplens.operators import catalog, trending
from shoplens.plans.registry import register
from shoplens.plans.sqlparts import ACTIONS_CTE, PRODUCT_DIM_CTE, trend_cte
from shoplens.sources import tables as T


def dimension(spark, sf_dir):
    return catalog.product_dimension(T.products_raw(spark, sf_dir), T.categories_raw(spark, sf_dir))


@register("product_dimension", f"WITH {PRODUCT_DIM_CTE} SELECT * FROM dim")
def q_product_dimension(spark, sf_dir):
    """PRJ1 + PRJ2 + JN1 (SNK1 writes this table)."""
    return dimension(spark, sf_dir)


def _trending_sql(days: int, limit: int) -> str:
    return f"""WITH {ACTIONS_CTE}, {PRODUCT_DIM_CTE}, {trend_cte(days)},
top AS (SELECT * FROM trend ORDER BY trend_score DESC, product_id ASC LIMIT {limit})
SELECT t.product_id, d.title, d.category, d.price, t.trend_score, t.raw_score, t.growth_rate,
       t.views_today
FROM top t LEFT JOIN dim d ON t.product_id = d.product_id"""


@register("trending_products", _trending_sql(7, 10))
def q_trending_products(spark, sf_dir):
    """TRD1/REC6 + TOP2: the week's top-10 trending products with their dimension row."""
    return trending.trending_products(T.actions(spark, sf_dir), dimension(spark, sf_dir), "week", 10)


@register("trending_products_day", _trending_sql(1, 20))
def q_trending_products_day(spark, sf_dir):
    """TRD1 + TOP2 for a one-day period, top 20."""
    return trending.trending_products(T.actions(spark, sf_dir), dimension(spark, sf_dir), "day", 20)


@register("trend_scores_month", f"""WITH {ACTIONS_CTE}, {trend_cte(30)}
SELECT product_id, raw_score, trend_score, growth_rate, views_today FROM trend""")
def q_trend_scores_month(spark, sf_dir):
    """TRD1 for every product over a 30-day period (no top-k cut)."""
    return trending.trend_scores(T.actions(spark, sf_dir), "month")


_CAT_SQL = """WITH {actions}, {dim}, {trend},
j AS (SELECT d.category, t.product_id, d.title, d.price, t.trend_score, t.growth_rate,
             t.views_today,
             row_number() OVER (PARTITION BY d.category ORDER BY t.trend_score DESC,
                                t.product_id ASC) AS rank
      FROM trend t JOIN dim d ON t.product_id = d.product_id {where})
SELECT category, rank, product_id, title, price, trend_score, growth_rate, views_today
FROM j WHERE rank <= {limit}"""


@register("category_trending", _CAT_SQL.format(actions=ACTIONS_CTE, dim=PRODUCT_DIM_CTE,
                                               trend=trend_cte(7), where="", limit=3))
def q_category_trending(spark, sf_dir):
    """TOP3: top-3 trending products inside every category."""
    return trending.trending_by_category(T.actions(spark, sf_dir), dimension(spark, sf_dir),
                                         "week", 3)


@register("category_filter_trending", _CAT_SQL.format(
    actions=ACTIONS_CTE, dim=PRODUCT_DIM_CTE, trend=trend_cte(7),
    where="WHERE d.category = 'PROMO'", limit=10))
def q_category_filter_trending(spark, sf_dir):
    """FLT6 + TOP3: trending inside one named category (unknown name -> empty)."""
    return trending.trending_by_category(T.actions(spark, sf_dir), dimension(spark, sf_dir),
                                         "week", 10, category="PROMO")
