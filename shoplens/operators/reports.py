"""Report assembly (RPT1-RPT3): one-row documents of nested structs.

Every part is a one-row aggregate; they are combined with scalar subqueries
and array aggregates, never by collecting to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.operators import profiles as P


def _one_row_struct(df: DataFrame):
    """A one-row DataFrame as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


def _top_array(df: DataFrame, order_cols: list):
    """A small ordered top-k DataFrame as one array<struct> scalar."""
    cols = [c for c in df.columns if not c.startswith("_")]  # not the order columns
    arr = F.array_sort(F.collect_list(F.struct(*order_cols, F.struct(*cols).alias("row"))))
    return df.select(arr.alias("a")).select(F.transform("a", lambda x: x["row"]).alias("a")).scalar()


def report_document(summary: DataFrame, user_profiles: DataFrame, product_profiles: DataFrame,
                    recommendations: DataFrame | None = None) -> DataFrame:
    """RPT1 from its parts: the one-row processing summary, the profiles, and
    recommendations (AGG8) when given."""
    ua = P.entity_analytics(user_profiles, "user")
    pa = P.entity_analytics(product_profiles, "product")
    tu = P.top_entities(user_profiles, "user_id", 5)
    tp = P.top_entities(product_profiles, "product_id", 5)
    act = lambda: (F.col("reviews") + F.col("interactions"))
    tu = tu.withColumn("_o", -act())
    tp = tp.withColumn("_o", -act())
    base = summary.select(
        F.current_timestamp().cast("timestamp_ntz").alias("generated_at"),
        F.lit(C.ANALYTICS_DATA_SOURCE).alias("data_source"),
        F.struct(*summary.columns).alias("processing_summary"),
        F.struct(_one_row_struct(ua).alias("totals"),
                 _top_array(tu, ["_o", "user_id"]).alias("top_users")).alias("user_analytics"),
        F.struct(_one_row_struct(pa).alias("totals"),
                 _top_array(tp, ["_o", "product_id"]).alias("top_products")).alias("product_analytics"),
    )
    if recommendations is not None:
        from shoplens.operators.recommend import recommendation_analytics
        base = base.withColumn("recommendation_analytics",
                               _one_row_struct(recommendation_analytics(recommendations)))
    return base


def analytics_document(reviews: DataFrame, interactions: DataFrame, user_profiles: DataFrame,
                       product_profiles: DataFrame, recommendations: DataFrame | None = None
                       ) -> DataFrame:
    """RPT1 of batch tables: processing summary, user/product analytics with
    their top 5, recommendation analytics when recommendations are given.  Each
    profile table is read by its totals and by its top list: stored once."""
    users, products = user_profiles.checkpoint(eager=True), product_profiles.checkpoint(eager=True)
    return report_document(P.processing_summary(reviews, interactions), users, products, recommendations)


def behaviour_report(actions: DataFrame, dimension: DataFrame, regions: DataFrame) -> DataFrame:
    """RPT3: one-row user-behaviour document: action counts, funnel, user
    counts, category shares, peak hours and top regions (each part a small
    aggregate; the lists are bounded by categories, hours and regions)."""
    from shoplens.operators import behavior as B
    counts = B.action_counts(actions)
    funnel = B.conversion_funnel(actions)
    users = B.user_counts(actions)
    share = B.category_share(actions, dimension)
    peaks = B.peak_hours(actions, 3).withColumn("_o", -F.col("events"))
    regions_top = B.region_ranking(actions, regions, 3).withColumn("_o", -F.col("events"))
    return counts.select(
        F.current_timestamp().cast("timestamp_ntz").alias("generated_at"),
        F.struct(*counts.columns).alias("action_counts"),
        _one_row_struct(funnel).alias("conversion_funnel"),
        _one_row_struct(users).alias("user_counts"),
        _top_array(share.withColumn("_o", -F.col("events")), ["_o", "category"]).alias("category_share"),
        _top_array(peaks, ["_o", "hour"]).alias("peak_hours"),
        _top_array(regions_top, ["_o", "region"]).alias("top_regions"))
