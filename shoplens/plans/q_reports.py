"""Report documents (RPT1-RPT3) as JSON columns, each with SQL that writes the same JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.operators import profiles as P
from shoplens.operators import recommend as RC
from shoplens.operators import reports as R
from shoplens.plans import sqlparts as Q
from shoplens.plans.q_behavior import _A
from shoplens.plans.q_catalog import dimension
from shoplens.plans.q_events import reviews
from shoplens.plans.q_profiles import products, users
from shoplens.plans.q_recommend import neighbour_recs, sets
from shoplens.plans.registry import ORACLE, register
from shoplens.sources import tables as T


def as_json(df, *keep):
    """The struct and array columns of a document as JSON text, the others as they are."""
    return df.select(*keep, *[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in df.columns if c not in keep])


def row_json(sql: str) -> str:
    return f"(SELECT to_json(t) FROM ({sql}) t)"


def list_sql(sql: str, columns: str, order: str) -> str:
    """A list of rows as JSON text; ``columns`` in document order."""
    fields = ", ".join(f"'{c}': {c}" for c in columns.split())
    return f"(SELECT list({{{fields}}} ORDER BY {order}) FROM ({sql}) t)"


def _entities(kind: str) -> str:
    key, other = ("user_id", "products_count") if kind == "user" else ("product_id", "unique_users")
    top = list_sql(ORACLE[f"top_{kind}s"], f"{key} reviews interactions avg_rating {other}", f"reviews + interactions DESC, {key}")
    return f"to_json({{'totals': (SELECT t FROM ({ORACLE[f'{kind}_analytics']}) t), 'top_{kind}s': {top}}})"


@register("analytics_report_json", f"""SELECT '{C.ANALYTICS_DATA_SOURCE}' AS data_source,
  {row_json(ORACLE['processing_summary'])}::VARCHAR AS processing_summary,
  {_entities('user')}::VARCHAR AS user_analytics, {_entities('product')}::VARCHAR AS product_analytics,
  {row_json(ORACLE['recommendation_analytics'])}::VARCHAR AS recommendation_analytics""")
def q_analytics_report_json(spark, sf_dir):
    """RPT1 with the recommendation section (AGG8), its parts as JSON."""
    rv, acts = reviews(spark, sf_dir), T.actions(spark, sf_dir)
    doc = R.analytics_document(rv, acts, P.user_profiles(rv, acts), P.product_profiles(rv, acts),
                               neighbour_recs(spark, sf_dir))
    return as_json(doc.drop("generated_at"), "data_source")


_ITEM = "rank product_id confidence predicted_rating total_reviews unique_users reason"


@register("recommendation_documents_json", f"""WITH recs AS MATERIALIZED ({ORACLE['user_recommendations']}),
prof AS ({ORACLE['user_profiles']}),
lists AS (SELECT user_id, list({{{', '.join(f"'{c}': {c}" for c in _ITEM.split())}}} ORDER BY rank) AS l FROM recs GROUP BY user_id)
SELECT l.user_id, '{C.RECOMMENDATION_METHOD}' AS method,
  CASE WHEN p.user_id IS NOT NULL THEN to_json({{'total_reviews': reviews, 'avg_rating': {Q.rhu('avg_rating', 2)},
    'products_reviewed': products_count}})::VARCHAR END AS user_profile_summary, to_json(l)::VARCHAR AS recommendations
FROM (SELECT user_id, l FROM lists) l LEFT JOIN prof p ON p.user_id = l.user_id""".replace("to_json(l)", "to_json(l.l)"))
def q_recommendation_documents_json(spark, sf_dir):
    """RPT2: one document per user, its parts as JSON."""
    recs = RC.recommend_for_users(sets(spark, sf_dir), products(spark, sf_dir))
    return as_json(RC.recommendation_documents(recs, users(spark, sf_dir)), "user_id", "method")


_COUNTS = f"""{_A} SELECT count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'click') AS clicks,
  count(*) FILTER (WHERE action = 'purchase') AS purchases, count(*) FILTER (WHERE action = 'like') AS likes,
  count(*) FILTER (WHERE action = 'share') AS shares, count(*) FILTER (WHERE action = 'cart_add') AS cart_adds FROM actions"""


@register("behaviour_report_json", f"""SELECT {row_json(_COUNTS)}::VARCHAR AS action_counts,
  {row_json(ORACLE['conversion_funnel'])}::VARCHAR AS conversion_funnel, {row_json(ORACLE['user_counts'])}::VARCHAR AS user_counts,
  to_json({list_sql(ORACLE['category_share'], 'category events share_pct growth_pct', 'events DESC, category')})::VARCHAR AS category_share,
  to_json({list_sql(ORACLE['peak_hours'], 'hour events active_users', 'events DESC, hour')})::VARCHAR AS peak_hours,
  to_json({list_sql(ORACLE['region_ranking'], 'region events users purchases', 'events DESC, region')})::VARCHAR AS top_regions""")
def q_behaviour_report_json(spark, sf_dir):
    """RPT3: the user-behaviour document, its parts as JSON."""
    doc = R.behaviour_report(T.actions(spark, sf_dir), dimension(spark, sf_dir), T.customer_regions(spark, sf_dir))
    return as_json(doc.drop("generated_at"))
