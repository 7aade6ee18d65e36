"""Behaviour analytics queries (AGG10-AGG20, WIN4, STR2/STR3 batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import behavior as B
from shoplens.plans import sqlparts as Q
from shoplens.plans.q_catalog import dimension
from shoplens.plans.registry import register
from shoplens.sources import tables as T

_A = f"WITH {Q.ACTIONS_CTE}"
_AD = f"WITH {Q.ACTIONS_CTE}, {Q.PRODUCT_DIM_CTE}, ac AS (SELECT a.*, d.category FROM actions a LEFT JOIN dim d ON a.product_id = d.product_id)"
_EV = """WITH ev AS (SELECT event_id, ts AS timestamp, user_id, event_type AS action, value,
                 json_extract_string(props, '$.k') AS product_id FROM events)"""


def _acts(spark, sf_dir):
    return T.actions(spark, sf_dir)


@register("action_counts_daily", f"""{_A}
SELECT CAST(timestamp AS DATE) AS day,
       count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'click') AS clicks,
       count(*) FILTER (WHERE action = 'purchase') AS purchases,
       count(*) FILTER (WHERE action = 'like') AS likes, count(*) FILTER (WHERE action = 'share') AS shares,
       count(*) FILTER (WHERE action = 'cart_add') AS cart_adds
FROM actions GROUP BY 1""")
def q_action_counts_daily(spark, sf_dir):
    """AGG10: pivot of action counts per day."""
    a = _acts(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    return B.action_counts(a, ["day"])


@register("conversion_funnel", f"""{_A},
f AS (SELECT count(*) FILTER (WHERE action = 'view') AS views,
             count(*) FILTER (WHERE action = 'click') AS clicks,
             count(*) FILTER (WHERE action = 'cart_add') AS cart_adds,
             count(*) FILTER (WHERE action = 'purchase') AS purchases FROM actions)
SELECT *, CASE WHEN views > 0 THEN {Q.rhu('100.0::DOUBLE * purchases / views', 2)} END AS conversion_rate
FROM f""")
def q_conversion_funnel(spark, sf_dir):
    """AGG11."""
    return B.conversion_funnel(_acts(spark, sf_dir))


@register("user_counts", f"""{_A},
day_t AS (SELECT date_trunc('day', max(timestamp)) AS day FROM actions),
fu AS (SELECT user_id, min(timestamp) AS f, max(timestamp) AS l FROM actions GROUP BY user_id),
u AS (SELECT count(*) AS total_users, count(*) FILTER (WHERE l >= day) AS active_users_today,
             count(*) FILTER (WHERE f >= day) AS new_users_today FROM fu CROSS JOIN day_t),
o AS (SELECT a.user_id, a.timestamp,
             CASE WHEN lag(a.timestamp) OVER (PARTITION BY a.user_id ORDER BY a.timestamp) IS NULL
                    OR a.timestamp - lag(a.timestamp) OVER (PARTITION BY a.user_id ORDER BY a.timestamp)
                       >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
      FROM actions a CROSS JOIN day_t WHERE a.timestamp >= day_t.day)
SELECT total_users, active_users_today, new_users_today,
       active_users_today - new_users_today AS returning_users_today,
       (SELECT sum(new_s) FROM o) AS active_sessions
FROM u""")
def q_user_counts(spark, sf_dir):
    """AGG12 (+ STR3 session count)."""
    return B.user_counts(_acts(spark, sf_dir))


@register("category_share", f"""{_AD},
now_t AS (SELECT max(timestamp) AS now FROM actions),
per AS (SELECT category, count(*) AS events,
               count(*) FILTER (WHERE timestamp > now - INTERVAL 7 DAY) AS c,
               count(*) FILTER (WHERE timestamp > now - INTERVAL 14 DAY
                                AND timestamp <= now - INTERVAL 7 DAY) AS p
        FROM ac CROSS JOIN now_t GROUP BY category),
tot AS (SELECT sum(events) AS total FROM per)
SELECT category, events, {Q.rhu('100.0::DOUBLE * events / total', 2)} AS share_pct,
       CASE WHEN p > 0 THEN {Q.rhu('100.0::DOUBLE * (c - p) / p', 2)} END AS growth_pct
FROM per CROSS JOIN tot""")
def q_category_share(spark, sf_dir):
    """AGG13."""
    return B.category_share(_acts(spark, sf_dir), dimension(spark, sf_dir))


@register("category_performance", f"""{_AD},
g AS (SELECT category,
             count(*) FILTER (WHERE action IN ('purchase', 'like', 'cart_add')) AS recommendations,
             count(*) FILTER (WHERE action = 'view') AS views,
             count(*) FILTER (WHERE action = 'click') AS clicks,
             count(*) FILTER (WHERE action = 'purchase') AS purchases
      FROM ac GROUP BY category)
SELECT category, recommendations, views, clicks, purchases,
       CASE WHEN views > 0 THEN {Q.rhu('clicks / views', 4)} END AS click_through,
       CASE WHEN views > 0 THEN {Q.rhu('purchases / views', 4)} END AS conversion
FROM g""")
def q_category_performance(spark, sf_dir):
    """AGG14."""
    return B.category_performance(_acts(spark, sf_dir), dimension(spark, sf_dir))


@register("activity_heatmap", f"""{_A}
SELECT dayofweek(timestamp) + 1 AS weekday, hour(timestamp) AS hour,
       count(DISTINCT user_id) AS active_users, count(*) AS events
FROM actions GROUP BY 1, 2""")
def q_activity_heatmap(spark, sf_dir):
    """AGG15 heatmap (weekday 1 = Sunday)."""
    return B.activity_heatmap(_acts(spark, sf_dir))


@register("peak_hours", f"""{_A}
SELECT hour(timestamp) AS hour, count(*) AS events, count(DISTINCT user_id) AS active_users
FROM actions GROUP BY 1 ORDER BY events DESC, hour ASC LIMIT 3""")
def q_peak_hours(spark, sf_dir):
    """AGG15 top-3 hours."""
    return B.peak_hours(_acts(spark, sf_dir), 3)


@register("region_ranking", f"""{_A},
geo AS (SELECT c.c_custkey AS user_id, r.r_name AS region FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT g.region, count(*) AS events, count(DISTINCT g.user_id) AS users,
       count(*) FILTER (WHERE a.action = 'purchase') AS purchases
FROM actions a JOIN geo g ON CAST(a.user_id AS BIGINT) = g.user_id
GROUP BY g.region ORDER BY events DESC, region ASC LIMIT 3""")
def q_region_ranking(spark, sf_dir):
    """AGG16."""
    return B.region_ranking(_acts(spark, sf_dir), T.customer_regions(spark, sf_dir), 3)


@register("daily_engagement", f"""{_A},
per AS (SELECT CAST(timestamp AS DATE) AS day, count(DISTINCT user_id) AS active_users,
               count(*) AS events FROM actions GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM per)
SELECT d.day, coalesce(p.active_users, 0) AS active_users, coalesce(p.events, 0) AS events
FROM days d LEFT JOIN per p ON d.day = p.day""")
def q_daily_engagement(spark, sf_dir):
    """AGG17 with zero-filled days."""
    return B.daily_engagement(_acts(spark, sf_dir))


@register("event_timeline", f"""{_A}
SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS period, action, count(*) AS events
FROM actions GROUP BY 1, 2""")
def q_event_timeline(spark, sf_dir):
    """AGG18: events per (day, action)."""
    return B.event_timeline(_acts(spark, sf_dir), "day")


@register("category_trend", f"""{_AD}
SELECT CAST(date_trunc('week', timestamp) AS TIMESTAMP) AS period, category, count(*) AS events,
       sum({Q.weight('action')})::DOUBLE AS score
FROM ac GROUP BY 1, 2""")
def q_category_trend(spark, sf_dir):
    """AGG18: events and weighted score per (week, category)."""
    return B.category_trend(_acts(spark, sf_dir), dimension(spark, sf_dir), "week")


@register("average_order_value", f"""{_EV}
SELECT count(*) AS orders, {Q.money_mean('value')} AS average_order_value
FROM ev WHERE action = 'purchase'""")
def q_average_order_value(spark, sf_dir):
    """AGG19."""
    return B.average_order_value(T.events_with_value(spark, sf_dir))


@register("headline_counts", f"""{_A}, {Q.PRODUCT_DIM_CTE},
day_t AS (SELECT date_trunc('day', max(timestamp)) AS day FROM actions)
SELECT (SELECT count(*) FROM dim) AS total_products, count(DISTINCT user_id) AS active_users,
       count(*) FILTER (WHERE action IN ('purchase', 'like', 'cart_add')) AS recommendations_today
FROM actions CROSS JOIN day_t WHERE timestamp >= day""")
def q_headline_counts(spark, sf_dir):
    """AGG20."""
    return B.headline_counts(_acts(spark, sf_dir), dimension(spark, sf_dir))


@register("ordered_funnel", f"""{_A},
s1 AS (SELECT user_id, product_id, min(timestamp) AS t FROM actions WHERE action = 'view' GROUP BY 1, 2),
s2 AS (SELECT a.user_id, a.product_id, min(a.timestamp) AS t FROM actions a
       JOIN s1 ON a.user_id = s1.user_id AND a.product_id = s1.product_id
       WHERE a.action = 'click' AND a.timestamp >= s1.t GROUP BY 1, 2),
s3 AS (SELECT a.user_id, a.product_id, min(a.timestamp) AS t FROM actions a
       JOIN s2 ON a.user_id = s2.user_id AND a.product_id = s2.product_id
       WHERE a.action = 'purchase' AND a.timestamp >= s2.t GROUP BY 1, 2),
u AS (SELECT 1 AS step_no, 'view' AS step, count(*) AS pairs FROM s1
      UNION ALL SELECT 2, 'click', count(*) FROM s2
      UNION ALL SELECT 3, 'purchase', count(*) FROM s3)
SELECT step_no, step, pairs,
       CASE WHEN lag(pairs) OVER (ORDER BY step_no) > 0
            THEN {Q.rhu('pairs / lag(pairs) OVER (ORDER BY step_no)', 4)} END AS rate_from_previous
FROM u""")
def q_ordered_funnel(spark, sf_dir):
    """WIN4: time-ordered view -> click -> purchase funnel per (user, product)."""
    return B.ordered_funnel(_acts(spark, sf_dir), ["view", "click", "purchase"])


@register("user_sessions", f"""{_A},
o AS (SELECT user_id, timestamp,
             CASE WHEN lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) IS NULL
                    OR timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp)
                       >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM actions),
g AS (SELECT user_id, timestamp,
             sum(new_s) OVER (PARTITION BY user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS sid
      FROM o)
SELECT user_id, min(timestamp) AS session_start, max(timestamp) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS events
FROM g GROUP BY user_id, sid""")
def q_user_sessions(spark, sf_dir):
    """STR3 (batch): 30-minute-gap sessions per user."""
    return B.user_sessions(_acts(spark, sf_dir))


@register("window_metrics", f"""{_EV},
g AS (SELECT date_trunc('hour', timestamp) AS window_start, count(DISTINCT user_id) AS active_users,
             count(*) AS events, count(*) FILTER (WHERE action = 'view') AS views,
             count(*) FILTER (WHERE action = 'purchase') AS purchases,
             {Q.money_mean("CASE WHEN action = 'purchase' THEN value END")} AS aov
      FROM ev GROUP BY 1)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, active_users, events,
       {Q.rhu('events / 3600.0::DOUBLE', 6)} AS events_per_second,
       CASE WHEN views > 0 THEN {Q.rhu('purchases / views', 4)} END AS conversion,
       aov AS average_order_value,
       CASE WHEN aov > 180.0 THEN 'warning' END AS alert
FROM g""")
def q_window_metrics(spark, sf_dir):
    """STR2 (batch form): hourly tumbling-window metrics with the SCL13 alert."""
    return B.window_metrics(T.events_with_value(spark, sf_dir), "1 hour")


@register("behaviour_report")
def q_behaviour_report(spark, sf_dir):
    """RPT3: the one-row user-behaviour document."""
    from shoplens.operators.reports import behaviour_report
    return behaviour_report(_acts(spark, sf_dir), dimension(spark, sf_dir), T.customer_regions(spark, sf_dir))


@register("sliding_window_metrics", f"""{_EV},
b AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, timestamp) AS bucket FROM ev),
x AS (SELECT *, bucket AS window_start FROM b
      UNION ALL SELECT *, bucket - INTERVAL 30 MINUTE AS window_start FROM b),
g AS (SELECT window_start, count(DISTINCT user_id) AS active_users, count(*) AS events,
             count(*) FILTER (WHERE action = 'view') AS views,
             count(*) FILTER (WHERE action = 'purchase') AS purchases,
             {Q.money_mean("CASE WHEN action = 'purchase' THEN value END")} AS aov
      FROM x GROUP BY 1)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, active_users, events,
       {Q.rhu('events / 3600.0::DOUBLE', 6)} AS events_per_second,
       CASE WHEN views > 0 THEN {Q.rhu('purchases / views', 4)} END AS conversion,
       aov AS average_order_value,
       CASE WHEN aov > 180.0 THEN 'warning' END AS alert
FROM g""")
def q_sliding_window_metrics(spark, sf_dir):
    """STR2 sliding variant (batch form): one-hour windows every 30 minutes."""
    return B.window_metrics(T.events_with_value(spark, sf_dir), "1 hour", slide="30 minutes")
