"""Profile and analytics queries (AGG1-AGG7, TOP1, RPT1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import profiles as P
from shoplens.operators import reports as R
from shoplens.plans import sqlparts as Q
from shoplens.plans.q_catalog import dimension
from shoplens.plans.q_events import reviews
from shoplens.plans.registry import register
from shoplens.sources import tables as T

_BASE = f"WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE}"
_USER = f"{_BASE}, {Q.profile_cte('user_id', 'product_id', 'products_count')}"
_PROD = f"{_BASE}, {Q.PRODUCT_DIM_CTE}, {Q.profile_cte('product_id', 'user_id', 'unique_users')}"


def users(spark, sf_dir, avg="stale"):
    return P.user_profiles(reviews(spark, sf_dir), T.actions(spark, sf_dir), avg)


def products(spark, sf_dir):
    return P.product_profiles(reviews(spark, sf_dir), T.actions(spark, sf_dir), dimension(spark, sf_dir))


@register("user_profiles", f"""{_USER}
SELECT user_id, reviews, interactions, products_count, total_rating, avg_rating FROM prof_user_id""")
def q_user_profiles(spark, sf_dir):
    """AGG1 + AGG3 (stale average) + UDA1."""
    return users(spark, sf_dir)


@register("user_profiles_plain_avg", f"""{_BASE},
r AS (SELECT user_id, {Q.rating_value('rating')} AS r FROM reviews WHERE coalesce(user_id <> '', false))
SELECT user_id, CASE WHEN count(r) > 0 THEN sum(r) / count(r) ELSE 0.0::DOUBLE END AS avg_rating
FROM r GROUP BY user_id""")
def q_user_profiles_plain_avg(spark, sf_dir):
    """AGG3 option ``avg="plain"``: the ordinary mean of the numeric ratings."""
    p = P.user_profiles(reviews(spark, sf_dir), T.actions(spark, sf_dir), "plain")
    return p.select("user_id", "avg_rating")


@register("product_profiles", f"""{_PROD}
SELECT p.product_id, p.reviews, p.interactions, p.unique_users, p.total_rating, p.avg_rating,
       d.category
FROM prof_product_id p LEFT JOIN dim d ON p.product_id = d.product_id""")
def q_product_profiles(spark, sf_dir):
    """AGG2 + AGG3, category from the product dimension."""
    return products(spark, sf_dir)


@register("user_preferences", f"""{_BASE},
v AS (SELECT user_id, lang AS preference FROM reviews UNION ALL SELECT user_id, source FROM reviews
      UNION ALL SELECT user_id, n_chars FROM reviews)
SELECT user_id, preference, count(*) AS count FROM v
WHERE coalesce(user_id <> '', false) AND preference IS NOT NULL AND preference <> ''
  AND length(preference) < 50
GROUP BY user_id, preference""")
def q_user_preferences(spark, sf_dir):
    """AGG4 (long form)."""
    return P.preference_counts(reviews(spark, sf_dir))


@register("user_profiles_with_preferences", f"""{_USER},
v AS (SELECT user_id, lang AS preference FROM reviews UNION ALL SELECT user_id, source FROM reviews
      UNION ALL SELECT user_id, n_chars FROM reviews),
c AS (SELECT user_id, preference, count(*) AS count FROM v
      WHERE coalesce(user_id <> '', false) AND preference IS NOT NULL AND preference <> ''
        AND length(preference) < 50 GROUP BY user_id, preference),
m AS (SELECT user_id, string_agg(preference || '=' || CAST(count AS VARCHAR), ',' ORDER BY preference) AS preferences
      FROM c GROUP BY user_id)
SELECT p.user_id, p.reviews, p.interactions, p.products_count, p.total_rating, p.avg_rating, m.preferences
FROM prof_user_id p LEFT JOIN m ON p.user_id = m.user_id""")
def q_user_profiles_with_preferences(spark, sf_dir):
    """AGG1 with AGG4's preference map inside the profile (written as key=count, sorted)."""
    maps = P.preference_maps(reviews(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("preferences")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return users(spark, sf_dir).join(maps.select("user_id", text.alias("preferences")), "user_id", "left")


@register("user_analytics", f"""{_USER}
SELECT count(*) AS total_users,
       {Q.rhu('sum(reviews) / count(*)', 2)} AS avg_reviews_per_user,
       coalesce({Q.rhu('avg(CASE WHEN avg_rating > 0 THEN avg_rating END)', 2)}, 0.0::DOUBLE)
         AS avg_rating_given
FROM prof_user_id""")
def q_user_analytics(spark, sf_dir):
    """AGG5."""
    return P.entity_analytics(users(spark, sf_dir), "user")


@register("product_analytics", f"""{_PROD}
SELECT count(*) AS total_products,
       {Q.rhu('sum(reviews) / count(*)', 2)} AS avg_reviews_per_product,
       coalesce({Q.rhu('avg(CASE WHEN avg_rating > 0 THEN avg_rating END)', 2)}, 0.0::DOUBLE)
         AS avg_product_rating
FROM prof_product_id""")
def q_product_analytics(spark, sf_dir):
    """AGG6."""
    return P.entity_analytics(products(spark, sf_dir), "product")


@register("processing_summary", f"""{_BASE},
u AS (SELECT user_id, product_id FROM reviews UNION ALL SELECT user_id, product_id FROM actions)
SELECT (SELECT count(*) FROM reviews) AS csv_reviews_processed,
       (SELECT count(*) FROM actions) AS interactions_processed,
       count(*) AS files_stored,
       count(DISTINCT CASE WHEN user_id <> '' THEN user_id END) AS unique_users,
       count(DISTINCT CASE WHEN product_id <> '' THEN product_id END) AS unique_products
FROM u""")
def q_processing_summary(spark, sf_dir):
    """AGG7."""
    return P.processing_summary(reviews(spark, sf_dir), T.actions(spark, sf_dir))


@register("top_users", f"""{_USER}
SELECT user_id, reviews, interactions, {Q.rhu('avg_rating', 2)} AS avg_rating, products_count
FROM prof_user_id ORDER BY reviews + interactions DESC, user_id ASC LIMIT 5""")
def q_top_users(spark, sf_dir):
    """TOP1 (users)."""
    return P.top_entities(users(spark, sf_dir), "user_id", 5)


@register("top_products", f"""{_PROD}
SELECT product_id, reviews, interactions, {Q.rhu('avg_rating', 2)} AS avg_rating, unique_users
FROM prof_product_id ORDER BY reviews + interactions DESC, product_id ASC LIMIT 5""")
def q_top_products(spark, sf_dir):
    """TOP1 (products)."""
    return P.top_entities(products(spark, sf_dir), "product_id", 5)


@register("analytics_report")
def q_analytics_report(spark, sf_dir):
    """RPT1: the comprehensive analytics document (one row of nested structs)."""
    from shoplens.plans.q_recommend import neighbour_recs
    rv, acts = reviews(spark, sf_dir), T.actions(spark, sf_dir)
    return R.analytics_document(rv, acts, P.user_profiles(rv, acts), P.product_profiles(rv, acts), neighbour_recs(spark, sf_dir))
