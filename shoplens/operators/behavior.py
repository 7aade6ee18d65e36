"""Behaviour analytics over user actions (AGG10-AGG20, WIN4, STR2/STR3 batch form).

The reference only fixes the output fields of these reports; each formula is
stated in its docstring.  Inputs are action tables with columns
(user_id, product_id, action, timestamp[, value]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.constants import ORDER_VALUE_ALERT_THRESHOLD, PIVOT_ACTIONS, PIVOT_NAMES
from shoplens.functions.scalars import (action_weight, is_stream_trigger, metric_alert, money_mean,
                                       round_half_up)


def action_counts(actions: DataFrame, by: list | None = None) -> DataFrame:
    """AGG10: counts per action as columns (listed values: no extra job to find
    them), zero when absent."""
    by = by or []
    g = actions.groupBy(*by).pivot("action", PIVOT_ACTIONS).count()
    for a in PIVOT_ACTIONS:
        g = g.withColumn(a, F.coalesce(F.col(a), F.lit(0)).cast("long"))
    return g.select(*by, *[F.col(a).alias(PIVOT_NAMES[a]) for a in PIVOT_ACTIONS])


def conversion_funnel(actions: DataFrame) -> DataFrame:
    """AGG11: view -> click -> cart_add -> purchase counts and
    conversion_rate = 100 * purchases / views (2 places, null without views)."""
    a = F.col("action")
    f = actions.agg(F.count_if(a == "view").alias("views"), F.count_if(a == "click").alias("clicks"),
                    F.count_if(a == "cart_add").alias("cart_adds"),
                    F.count_if(a == "purchase").alias("purchases"))
    return f.withColumn("conversion_rate",
                        round_half_up(F.try_divide(F.lit(100.0) * F.col("purchases"), F.col("views")), 2))


def last_day_start(actions: DataFrame):
    """Start of the latest calendar day in the data (scalar subquery)."""
    return actions.select(F.date_trunc("day", F.max("timestamp")).cast("timestamp_ntz")).scalar()


def user_counts(actions: DataFrame, session_gap: str = "30 minutes") -> DataFrame:
    """AGG12: total users, users active on the last day, new on that day (first
    seen that day), returning = active - new, sessions on that day (STR3 gap)."""
    day = last_day_start(actions)
    first = actions.groupBy("user_id").agg(F.min("timestamp").alias("first_seen"),
                                           F.max("timestamp").alias("last_seen"))
    users = first.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(F.col("last_seen") >= day).alias("active_users_today"),
        F.count_if(F.col("first_seen") >= day).alias("new_users_today"))
    sessions = (actions.where(F.col("timestamp") >= day)
                .groupBy("user_id", F.session_window("timestamp", session_gap)).count()
                .agg(F.count(F.lit(1)).alias("active_sessions")))
    return (users.withColumn("returning_users_today",
                             F.col("active_users_today") - F.col("new_users_today"))
            .withColumn("active_sessions", sessions.select("active_sessions").scalar()))


def with_category(per_product: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the category to measures already aggregated per product (left
    join: unknown products keep a null category).  Both sides have one row per
    product (and period), so a product with a third of all events is one row."""
    return per_product.join(dimension.select("product_id", "category"), "product_id", "left")


def category_share(actions: DataFrame, dimension: DataFrame, days: int = 7) -> DataFrame:
    """AGG13: share of all events per category (%, 2 places) and growth of the
    last ``days`` over the ``days`` before (%, 2 places, null when no base)."""
    now = actions.select(F.max("timestamp")).scalar()
    cur = F.timestamp_add("DAY", F.lit(-days), now)
    prev = F.timestamp_add("DAY", F.lit(-2 * days), now)
    ts = F.col("timestamp")
    counts = (actions.groupBy("product_id")
              .agg(F.count(F.lit(1)).alias("events"),
                   F.count_if(ts > cur).alias("current_events"),
                   F.count_if((ts > prev) & (ts <= cur)).alias("previous_events")))
    per = (with_category(counts, dimension).groupBy("category")
           .agg(*[F.sum(c).alias(c) for c in ("events", "current_events", "previous_events")]))
    # one row per category (a bounded table): the total is a window over it,
    # not a second pass over the events
    total = F.sum("events").over(Window.partitionBy())
    return per.select(
        "category", "events",
        round_half_up(F.lit(100.0) * F.col("events") / total, 2).alias("share_pct"),
        round_half_up(F.try_divide(F.lit(100.0) * (F.col("current_events") - F.col("previous_events")),
                                   F.col("previous_events")), 2).alias("growth_pct"))


def category_performance(actions: DataFrame, dimension: DataFrame) -> DataFrame:
    """AGG14: per category: recommendation triggers (purchase/like/cart_add),
    click-through = clicks/views and conversion = purchases/views (4 places)."""
    a = F.col("action")
    counts = actions.groupBy("product_id").agg(
        F.count_if(is_stream_trigger(a)).alias("recommendations"),
        F.count_if(a == "view").alias("views"), F.count_if(a == "click").alias("clicks"),
        F.count_if(a == "purchase").alias("purchases"))
    g = (with_category(counts, dimension).groupBy("category")
         .agg(*[F.sum(c).alias(c) for c in ("recommendations", "views", "clicks", "purchases")]))
    return g.select("category", "recommendations", "views", "clicks", "purchases",
                    round_half_up(F.try_divide(F.col("clicks"), F.col("views")), 4).alias("click_through"),
                    round_half_up(F.try_divide(F.col("purchases"), F.col("views")), 4).alias("conversion"))


def activity_heatmap(actions: DataFrame) -> DataFrame:
    """AGG15: distinct active users and events per (weekday, hour)."""
    return (actions.groupBy(F.dayofweek("timestamp").alias("weekday"),
                            F.hour("timestamp").alias("hour"))
            .agg(F.count_distinct("user_id").alias("active_users"),
                 F.count(F.lit(1)).alias("events")))


def peak_hours(actions: DataFrame, n: int = 3) -> DataFrame:
    """AGG15: the ``n`` busiest hours of day (events, ties: hour)."""
    g = actions.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("active_users"))
    return g.orderBy(F.desc("events"), F.asc("hour")).limit(n)


def region_ranking(actions: DataFrame, regions: DataFrame, n: int = 3) -> DataFrame:
    """AGG16: regions ranked by events of their users (ties: region)."""
    u = (actions.groupBy(F.col("user_id").cast("long").alias("user_id"))
         .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("action") == "purchase").alias("purchases")))
    g = (u.join(regions, "user_id").groupBy("region")
         .agg(F.sum("events").alias("events"), F.count_distinct("user_id").alias("users"),
              F.sum("purchases").alias("purchases")))
    return g.orderBy(F.desc("events"), F.asc("region")).limit(n)


def daily_engagement(actions: DataFrame) -> DataFrame:
    """AGG17: active users and events per day, days without events filled with 0."""
    per_day = (actions.groupBy(F.to_date("timestamp").alias("day"))
               .agg(F.count_distinct("user_id").alias("active_users"),
                    F.count(F.lit(1)).alias("events")))
    span = per_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    # one row per calendar day in the data's range: a small, bounded side
    return (days.join(per_day, "day", "left")
            .select("day", F.coalesce("active_users", F.lit(0)).alias("active_users"),
                    F.coalesce("events", F.lit(0)).alias("events")))


def event_timeline(actions: DataFrame, unit: str = "day") -> DataFrame:
    """AGG18: events per (period, action)."""
    return (actions.groupBy(F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("period"),
                            "action")
            .agg(F.count(F.lit(1)).alias("events")))


def category_trend(actions: DataFrame, dimension: DataFrame, unit: str = "week") -> DataFrame:
    """AGG18: events and weighted score per (period, category)."""
    counts = (actions.groupBy("product_id", F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("period"))
              .agg(F.count(F.lit(1)).alias("events"), F.sum(action_weight("action")).alias("score")))
    return (with_category(counts, dimension).groupBy("period", "category")
            .agg(F.sum("events").alias("events"), F.sum("score").alias("score")))


def average_order_value(events: DataFrame) -> DataFrame:
    """AGG19: mean value of purchases, overall and as order count (2 places)."""
    p = events.where(F.col("action") == "purchase")
    return p.agg(F.count(F.lit(1)).alias("orders"),
                 money_mean("value").alias("average_order_value"))


def headline_counts(actions: DataFrame, dimension: DataFrame) -> DataFrame:
    """AGG20: products in the catalogue, users active on the last day, and
    recommendation triggers on the last day."""
    day = last_day_start(actions)
    recent = actions.where(F.col("timestamp") >= day)
    act = recent.agg(F.count_distinct("user_id").alias("active_users"),
                     F.count_if(is_stream_trigger(F.col("action"))).alias("recommendations_today"))
    return act.withColumn("total_products", dimension.select(F.count(F.lit(1))).scalar()) \
              .select("total_products", "active_users", "recommendations_today")


def ordered_funnel(actions: DataFrame, steps: list[str], key: list[str] | None = None) -> DataFrame:
    """WIN4: pairs (user, product) reaching each step in time order.

    Step i is reached at the earliest time of action ``steps[i]`` that is not
    before the time step i-1 was reached.  Each step is one aggregate on the
    same key, so the key partitioning is reused; no per-key sort or list.
    """
    key = key or ["user_id", "product_id"]
    a = actions.select(*key, "action", "timestamp").where(F.col("action").isin(steps))
    reached = (a.where(F.col("action") == steps[0]).groupBy(*key)
               .agg(F.min("timestamp").alias("t")))
    rows = [reached.agg(F.count(F.lit(1)).alias("pairs")).select(
        F.lit(1).alias("step_no"), F.lit(steps[0]).alias("step"), "pairs")]
    for i, s in enumerate(steps[1:], start=2):
        nxt = (a.where(F.col("action") == s).join(reached.withColumnRenamed("t", "t_prev"), key)
               .where(F.col("timestamp") >= F.col("t_prev"))
               .groupBy(*key).agg(F.min("timestamp").alias("t")))
        rows.append(nxt.agg(F.count(F.lit(1)).alias("pairs")).select(
            F.lit(i).alias("step_no"), F.lit(s).alias("step"), "pairs"))
        reached = nxt
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    w = Window.orderBy("step_no")  # one row per step: a bounded table
    return out.withColumn("rate_from_previous", round_half_up(
        F.try_divide(F.col("pairs"), F.lag("pairs").over(w)), 4))


def user_sessions(actions: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """STR3 (batch form): sessions per user with ``session_window``; a session
    ends ``gap`` after its last event."""
    s = actions.groupBy("user_id", F.session_window("timestamp", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events")


def window_metrics(events: DataFrame, window: str = "1 hour", approx: bool = False,
                   threshold: float = ORDER_VALUE_ALERT_THRESHOLD, slide: str | None = None) -> DataFrame:
    """STR2 (batch form): per tumbling window (or sliding, with ``slide``):
    active users, events per second, conversion (purchases/views), average
    order value, and an alert when the average order value exceeds
    ``threshold``."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    a = F.col("action")
    # local-time window bounds: the length does not depend on the session zone
    seconds = F.expr("timestampdiff(SECOND, w.start, w.end)")
    win = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    g = events.groupBy(win.alias("w")).agg(
        distinct("user_id").alias("active_users"), F.count(F.lit(1)).alias("events"),
        F.count_if(a == "view").alias("views"), F.count_if(a == "purchase").alias("purchases"),
        money_mean(F.when(a == "purchase", F.col("value"))).alias("aov"))
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "active_users", "events",
        round_half_up(F.col("events") / seconds, 6).alias("events_per_second"),
        round_half_up(F.try_divide(F.col("purchases"), F.col("views")), 4).alias("conversion"),
        F.col("aov").alias("average_order_value"),
        metric_alert(F.col("aov"), threshold, "average order value").getField("level").alias("alert"))
