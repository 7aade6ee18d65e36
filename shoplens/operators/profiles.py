"""User and product profiles and the analytics built on them.

AGG1  user profile: reviews, interactions, distinct products (reviews only),
      total and average rating, preference counts
AGG2  product profile: same by product, distinct users, category
AGG3  stale-average rule: the average is refreshed only at a rated review and
      divides by all reviews seen so far, so
      avg = total_rating / (reviews up to and including the last rated one)
AGG4  preference map: non-empty metadata values shorter than 50 characters
AGG5/6  user / product analytics; AGG7 processing summary; TOP1 top entities

Reviews and interactions are unioned into one event table and aggregated in
one ``groupBy`` (partial aggregation before the shuffle).  The stale average
divides by all reviews less the unrated ones after the last rated: only the
unrated reviews are joined to the last rated arrival per entity, never the
whole event table, and no window sorts a hot entity's history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions.scalars import rating_value, round_half_up


def _events(reviews: DataFrame, interactions: DataFrame) -> DataFrame:
    rev = reviews.select(
        "user_id", "product_id", rating_value("rating").alias("rating_num"),
        F.struct(F.col("timestamp").alias("ts"), F.col("event_id").alias("id")).alias("arrival"),
        F.lit("review").alias("kind"))
    act = interactions.select(
        "user_id", "product_id", F.lit(None).cast("double").alias("rating_num"),
        F.lit(None).cast(rev.schema["arrival"].dataType).alias("arrival"),
        F.lit("interaction").alias("kind"))
    return rev.unionByName(act)


def _profile(ev: DataFrame, key: str, other: str, stale_avg: bool = True) -> DataFrame:
    present = F.coalesce(F.col(key) != "", F.lit(False))
    ev = ev.where(present)
    is_rev = F.col("kind") == "review"
    rated = is_rev & F.col("rating_num").isNotNull()
    other_present = is_rev & F.coalesce(F.col(other) != "", F.lit(False))
    prof = ev.groupBy(key).agg(
        F.count_if(is_rev).alias("reviews"),
        F.count_if(F.col("kind") == "interaction").alias("interactions"),
        F.count_distinct(F.when(other_present, F.col(other))).alias("distinct_" + other),
        F.coalesce(F.sum(F.when(is_rev, F.col("rating_num"))), F.lit(0.0)).alias("total_rating"),
        F.count_if(rated).alias("_rated"),
    )
    denom = F.col("_rated")
    if stale_avg:
        # only unrated reviews can follow the last rated one: those alone meet the join
        last = ev.where(rated).groupBy(key).agg(F.max("arrival").alias("last_rated"))
        after = (ev.where(is_rev & F.col("rating_num").isNull()).select(key, "arrival").join(last, key)
                 .where(F.col("arrival") > F.col("last_rated")).groupBy(key).agg(F.count(F.lit(1)).alias("_after")))
        prof = prof.join(after, key, "left")
        denom = F.when(F.col("_rated") > 0, F.col("reviews") - F.coalesce("_after", F.lit(0)))
    return (prof.withColumn("avg_rating", F.when(denom > 0, F.col("total_rating") / denom)
                            .otherwise(F.lit(0.0)))
            .drop("_after", "_rated"))


def user_profiles(reviews: DataFrame, interactions: DataFrame, avg: str = "stale") -> DataFrame:
    """AGG1 + AGG3: one row per user.  ``avg="plain"`` gives the ordinary mean."""
    p = _profile(_events(reviews, interactions), "user_id", "product_id", avg == "stale")
    return p.withColumnRenamed("distinct_product_id", "products_count")


def product_profiles(reviews: DataFrame, interactions: DataFrame, dimension: DataFrame | None = None,
                     avg: str = "stale") -> DataFrame:
    """AGG2 + AGG3: one row per product; ``category`` filled from the dimension
    (the reference declares the field and never fills it)."""
    p = _profile(_events(reviews, interactions), "product_id", "user_id", avg == "stale")
    p = p.withColumnRenamed("distinct_user_id", "unique_users")
    if dimension is not None:
        p = p.join(dimension.select("product_id", "category"), "product_id", "left")
    return p


def preference_counts(reviews: DataFrame) -> DataFrame:
    """AGG4 long form: (user_id, preference, count) from metadata values."""
    vals = (reviews.where(F.coalesce(F.col("user_id") != "", F.lit(False)))
            .select("user_id", F.explode(F.map_values("metadata")).alias("preference")))
    ok = (F.col("preference").isNotNull() & (F.col("preference") != "")
          & (F.length("preference") < C.PREFERENCE_MAX_LEN))
    return vals.where(ok).groupBy("user_id", "preference").agg(F.count(F.lit(1)).alias("count"))


def preference_maps(reviews: DataFrame) -> DataFrame:
    """AGG4 map form: user_id -> map(preference -> count)."""
    return (preference_counts(reviews).groupBy("user_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("preference", "count"))).alias("preferences")))


def entity_analytics(profiles: DataFrame, kind: str) -> DataFrame:
    """AGG5 (kind="user") / AGG6 (kind="product").

    total, mean reviews per entity (2 places) and the mean of the non-zero
    entity averages (2 places, 0 when none).
    """
    noun = "users" if kind == "user" else "products"
    per = "user" if kind == "user" else "product"
    rating_name = "avg_rating_given" if kind == "user" else "avg_product_rating"
    nz = F.when(F.col("avg_rating") > 0, F.col("avg_rating"))
    return profiles.agg(
        F.count(F.lit(1)).alias(f"total_{noun}"),
        round_half_up(F.sum("reviews") / F.count(F.lit(1)), 2).alias(f"avg_reviews_per_{per}"),
        F.coalesce(round_half_up(F.avg(nz), 2), F.lit(0.0)).alias(rating_name),
    )


def top_entities(profiles: DataFrame, key: str, n: int = 5) -> DataFrame:
    """TOP1: the ``n`` most active entities by reviews + interactions (ties: key)."""
    activity = F.col("reviews") + F.col("interactions")
    other = "products_count" if "products_count" in profiles.columns else "unique_users"
    return (profiles.orderBy(activity.desc(), F.col(key).asc()).limit(n)
            .select(key, "reviews", "interactions",
                    round_half_up(F.col("avg_rating"), 2).alias("avg_rating"), other))


def processing_summary(reviews: DataFrame, interactions: DataFrame, approx: bool = False) -> DataFrame:
    """AGG7: events processed, files stored (one per event) and distinct users
    and products over both event kinds."""
    ev = _events(reviews, interactions)
    distinct = F.approx_count_distinct if approx else F.count_distinct
    u = F.when(F.coalesce(F.col("user_id") != "", F.lit(False)), F.col("user_id"))
    p = F.when(F.coalesce(F.col("product_id") != "", F.lit(False)), F.col("product_id"))
    return ev.agg(
        F.count_if(F.col("kind") == "review").alias("csv_reviews_processed"),
        F.count_if(F.col("kind") == "interaction").alias("interactions_processed"),
        F.count(F.lit(1)).alias("files_stored"),
        distinct(u).alias("unique_users"),
        distinct(p).alias("unique_products"),
    )
