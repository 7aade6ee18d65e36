"""Trending products (TRD1 / REC6) and its top-k forms (TOP2, TOP3, FLT6).

Definition (the reference only fixes the output fields):
  now          = latest action time in the data
  current      = actions in (now - period, now]
  previous     = actions in (now - 2*period, now - period]
  raw_score    = sum of action weights in the current period, per product
  trend_score  = raw_score / max raw_score over products, 4 places
  growth_rate  = 100 * (raw_score - previous raw score) / previous, 2 places,
                 null when the previous score is 0
  views_today  = views in (now - 1 day, now]

One pass over the actions with conditional sums (a partial aggregate before the
shuffle); the global maximum is a scalar subquery, not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions.scalars import action_weight, round_half_up
from shoplens.operators.joins import lookup_small


def period_days(period: str) -> int:
    if period not in C.PERIOD_DAYS:
        raise ValueError(f"period must be one of {sorted(C.PERIOD_DAYS)}, got {period!r}")
    return C.PERIOD_DAYS[period]


def check_limit(kind: str, limit: int) -> int:
    """FLT7: argument bounds, checked on the driver before any plan is built."""
    lo, hi = C.LIMIT_BOUNDS[kind]
    if not (lo <= int(limit) <= hi):
        raise ValueError(f"limit for {kind} must be in [{lo}, {hi}], got {limit}")
    return int(limit)


def within_bounds(kind: F.Column, limit: F.Column) -> F.Column:
    """FLT7 over a table of requests: is ``limit`` inside the bounds of its kind?  False for an unknown kind or a null."""
    inside = F.lit(False)
    for name, (lo, hi) in C.LIMIT_BOUNDS.items():
        inside = F.when(kind == name, limit.between(lo, hi)).otherwise(inside)
    return F.coalesce(inside, F.lit(False))


def trend_scores(actions: DataFrame, period: str = "week") -> DataFrame:
    """Per product: raw_score, previous_score, trend_score, growth_rate, views_today."""
    days = period_days(period)
    acts = actions.select("product_id", "action", "timestamp").where(F.col("product_id").isNotNull())
    now = actions.select(F.max("timestamp")).scalar()
    cur_start = F.timestamp_add("DAY", F.lit(-days), now)
    prev_start = F.timestamp_add("DAY", F.lit(-2 * days), now)
    day_start = F.timestamp_add("DAY", F.lit(-1), now)
    ts = F.col("timestamp")
    w = action_weight("action")
    in_cur = ts > cur_start
    in_prev = (ts > prev_start) & (ts <= cur_start)
    agg = (acts.where(ts > prev_start)
           .groupBy("product_id")
           .agg(F.sum(F.when(in_cur, w).otherwise(0.0)).alias("raw_score"),
                F.sum(F.when(in_prev, w).otherwise(0.0)).alias("previous_score"),
                F.count_if((ts > day_start) & (F.col("action") == "view")).alias("views_today")))
    top = agg.select(F.max("raw_score")).scalar()
    return agg.select(
        "product_id",
        round_half_up(F.col("raw_score"), 4).alias("raw_score"),
        F.when(top > 0, round_half_up(F.col("raw_score") / top, 4)).otherwise(F.lit(0.0)
                                                                             ).alias("trend_score"),
        F.when(F.col("previous_score") > 0,
               round_half_up(F.lit(100.0) * (F.col("raw_score") - F.col("previous_score"))
                             / F.col("previous_score"), 2)).alias("growth_rate"),
        F.col("views_today"),
    )


def trending_products(actions: DataFrame, dimension: DataFrame, period: str = "week",
                      limit: int = 10) -> DataFrame:
    """TOP2: the ``limit`` products with the highest trend score, with title,
    category and price from the product dimension (ties: product id)."""
    limit = check_limit("trending", limit)
    scores = trend_scores(actions, period)
    top = scores.orderBy(F.desc("trend_score"), F.asc("product_id")).limit(limit)
    # the top-k side is bounded by ``limit`` rows; the dimension is only streamed
    return (lookup_small(top, dimension, "product_id", ["title", "category", "price"])
            .select("product_id", "title", "category", "price", "trend_score", "raw_score",
                    "growth_rate", "views_today"))


def trending_by_category(actions: DataFrame, dimension: DataFrame, period: str = "week",
                         limit: int = 3, category: str | None = None) -> DataFrame:
    """TOP3 (+ FLT6 when ``category`` is given): top products inside each category.

    ``row_number() <= limit`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so at most ``limit`` rows per category and map task move.
    """
    limit = check_limit("category", limit)
    scores = trend_scores(actions, period)
    dim = dimension.select("product_id", "title", "category", "price")
    if category is not None:
        dim = dim.where(F.col("category") == F.lit(category))
    joined = scores.join(dim, "product_id")
    w = Window.partitionBy("category").orderBy(F.desc("trend_score"), F.asc("product_id"))
    return (joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("category", "rank", "product_id", "title", "price", "trend_score",
                    "growth_rate", "views_today"))
