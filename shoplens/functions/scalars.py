"""Row-level functions as native Spark expressions (no Python UDF).

Each returns a ``Column`` so it stays inside whole-stage codegen and works the
same on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens import constants as C

__all__ = [
    "round_half_up", "is_numeric_text", "rating_value", "recommendation_weight",
    "quality_score", "action_weight", "review_length", "rating_actions",
    "interaction_confidence", "neighbour_confidence", "als_confidence", "predicted_rating",
    "reason_text", "event_priority", "is_stream_trigger", "is_api_trigger", "metric_alert",
    "non_empty_metadata_count", "whitespace_tokens", "cents", "money_mean", "sentiment_counts",
    "sentiment_from_counts",
]


EXACT_INTEGERS = float(2 ** 53)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Round half away from zero for non-negative values, identically in SQL.

    ``floor(x * 10^k + 0.5) / 10^k`` is written the same way in the oracle SQL
    so both engines do the same double arithmetic.  From 2^53 / 10^k on a double
    has no digits left to round (and ``floor`` would not fit in a long), so such
    values, and NaN, stay as they are.
    """
    scale = float(10 ** digits)
    x = _col(c).cast("double")
    return F.when(F.abs(x) < F.lit(EXACT_INTEGERS / scale), F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)) \
        .otherwise(x)


def is_numeric_text(c) -> Column:
    """FLT1: text made of digits and dots that also parses as a number.

    ``4.5.1`` passes the digit test but does not parse, so it is not a rating.
    """
    c = _col(c)
    return (F.coalesce(c.rlike(r"^[0-9.]*[0-9][0-9.]*$"), F.lit(False))
            & c.try_cast("double").isNotNull())


def rating_value(c) -> Column:
    """The numeric rating of a text rating, null when not numeric."""
    c = _col(c)
    return F.when(is_numeric_text(c), c.try_cast("double"))


def whitespace_tokens(text) -> Column:
    """Number of whitespace-separated tokens, like Python's ``split()``: Unicode
    blanks and the separators U+001C to U+001F, leading and trailing ones too."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+")
    return F.size(F.filter(parts, lambda p: p != ""))


def sentiment_counts(text) -> Column:
    """Word-list hits of a review: struct(has, pos, neg, tokens).

    Kept as one column so the 27 substring tests run once per row; tokens are
    counted only when there is a hit (the only case that needs them).
    """
    lower = F.lower(_col(text))
    pos = sum((F.when(F.contains(lower, F.lit(w)), 1).otherwise(0) for w in C.POSITIVE_WORDS),
              F.lit(0))
    neg = sum((F.when(F.contains(lower, F.lit(w)), 1).otherwise(0) for w in C.NEGATIVE_WORDS),
              F.lit(0))
    return F.struct(pos.alias("pos"), neg.alias("neg"),
                    F.when(pos + neg > 0, whitespace_tokens(text)).alias("tokens"))


def sentiment_from_counts(counts) -> Column:
    """SCL1: word-list sentiment of a review, from ``sentiment_counts``.

    A word counts once when it occurs anywhere (as a substring) in the lower-cased
    text.  score = pos/(pos+neg), confidence = hits/tokens, both to 3 places.
    Empty text or no hit gives score 0.5, confidence 0 and null counts.
    """
    c = _col(counts)
    pos, neg, tokens = c["pos"], c["neg"], c["tokens"]
    hits = pos + neg
    has = F.coalesce(hits > 0, F.lit(False))
    score = F.when(has, round_half_up(pos / hits, 3)).otherwise(F.lit(0.5))
    conf = F.when(has & (tokens > 0), round_half_up(hits / tokens, 3)).otherwise(F.lit(0.0))
    return F.struct(score.alias("score"), conf.alias("confidence"),
                    F.when(has, pos).alias("positive_words"),
                    F.when(has, neg).alias("negative_words"))


def review_length(text) -> Column:
    """SCL5: characters of the review text, 0 when absent."""
    return F.length(F.coalesce(_col(text), F.lit(""))).cast("int")


def recommendation_weight(rating, text) -> Column:
    """SCL2: 1 x (rating/5 when numeric) x (1 + 0.2 * min(len/100, 2) when text), 3 places."""
    r = rating_value(rating)
    t = _col(text)
    length = F.length(F.coalesce(t, F.lit("")))
    w = F.lit(1.0) * F.coalesce(r / F.lit(5.0), F.lit(1.0))
    w = w * F.when(length > 0, F.lit(1.0) + F.least(length / F.lit(100.0), F.lit(2.0)) * F.lit(0.2)
                   ).otherwise(F.lit(1.0))
    return round_half_up(w, 3)


def non_empty_metadata_count(metadata) -> Column:
    m = _col(metadata)
    return F.coalesce(F.size(F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))), F.lit(0))


def quality_score(rating, text, metadata) -> Column:
    """SCL3: 0.5 base, +0.2 rating, +0.2 text, +0.1 text over 50 chars,
    +min(0.05 * non-empty metadata values, 0.2); capped at 1.0; 3 places."""
    r, t = _col(rating), _col(text)
    length = F.length(F.coalesce(t, F.lit("")))
    s = (F.lit(0.5)
         + F.when(F.coalesce(r, F.lit("")) != "", 0.2).otherwise(0.0)
         + F.when(length > 0, 0.2).otherwise(0.0)
         + F.when(length > 50, 0.1).otherwise(0.0)
         + F.least(non_empty_metadata_count(metadata) * F.lit(0.05), F.lit(0.2)))
    return round_half_up(F.least(s, F.lit(1.0)), 3)


def action_weight(action) -> Column:
    """SCL4: weight of an interaction action; unknown or null -> 1.0."""
    pairs = []
    for k, v in C.ACTION_WEIGHTS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(_col(action), F.lit(""))),
                      F.lit(C.DEFAULT_ACTION_WEIGHT))


def rating_actions(rating) -> Column:
    """SCL6: actions a rating implies: view always; >=3 click; >=4 cart_add,
    purchase; >=4.5 like.  A zero or null rating gives only view."""
    r = _col(rating)
    ok = r.isNotNull() & (r != 0)
    return F.filter(F.array(
        F.lit("view"),
        F.when(ok & (r >= 3), F.lit("click")),
        F.when(ok & (r >= 4), F.lit("cart_add")),
        F.when(ok & (r >= 4), F.lit("purchase")),
        F.when(ok & (r >= 4.5), F.lit("like")),
    ), lambda x: x.isNotNull())


def interaction_confidence(rating) -> Column:
    """SCL7: 0.9 when the rating is at least 4, else 0.7."""
    r = _col(rating)
    return F.when(r.isNotNull() & (r != 0) & (r >= 4), F.lit(0.9)).otherwise(F.lit(0.7))


def neighbour_confidence(score) -> Column:
    """SCL8 (neighbour path): min(score, 1) to 3 places."""
    return round_half_up(F.least(_col(score), F.lit(1.0)), 3)


def als_confidence(rating) -> Column:
    """SCL8 (ALS path): predicted rating / 5 to 2 places."""
    return round_half_up(_col(rating) / F.lit(5.0), 2)


def predicted_rating(avg_rating) -> Column:
    """SCL9: product average to 2 places, else 4.0 when absent or zero."""
    a = _col(avg_rating)
    return F.when(a.isNotNull() & (a != 0), round_half_up(a, 2)).otherwise(
        F.lit(C.DEFAULT_PREDICTED_RATING))


def reason_text(score) -> Column:
    """SCL10: explanation string of a neighbour recommendation."""
    return F.concat(F.lit("Similar users (similarity: "),
                    round_half_up(_col(score), 2).cast("string"),
                    F.lit(") liked this product"))


def is_stream_trigger(action) -> Column:
    """FLT2: purchase, like and cart_add trigger a recommendation update."""
    return F.coalesce(_col(action).isin(C.STREAM_TRIGGER_ACTIONS), F.lit(False))


def is_api_trigger(action) -> Column:
    """FLT3: view, purchase and like trigger recommendations in the event API."""
    return F.coalesce(_col(action).isin(C.API_TRIGGER_ACTIONS), F.lit(False))


def event_priority(user_id, action) -> Column:
    """SCL11: priority, triggers and business impact of an API event.

    view with a user -> high; purchase with a user -> critical, two triggers,
    impact high; like/share (user or not) -> medium, one trigger, impact medium;
    anything else -> nulls.  A user id of 0 counts as no user.
    """
    u, a = _col(user_id), _col(action)
    has_user = u.isNotNull() & (u.cast("string") != "0") & (u.cast("string") != "")
    is_view = has_user & (a == "view")
    is_purchase = has_user & (a == "purchase")
    is_social = a.isin("like", "share")
    priority = (F.when(is_view, F.lit(C.PRIORITY_VIEW))
                .when(is_purchase, F.lit(C.PRIORITY_PURCHASE))
                .when(is_social, F.lit(C.PRIORITY_SOCIAL)))
    triggers = (F.when(is_view, F.lit(None).cast("array<string>"))
                .when(is_purchase, F.array(*[F.lit(t) for t in C.TRIGGERS_PURCHASE]))
                .when(is_social, F.array(*[F.lit(t) for t in C.TRIGGERS_SOCIAL])))
    impact = (F.when(is_view, F.lit(None).cast("string"))
              .when(is_purchase, F.lit(C.IMPACT_PURCHASE))
              .when(is_social, F.lit(C.IMPACT_SOCIAL)))
    return F.struct(priority.alias("action_priority"), triggers.alias("triggers"),
                    impact.alias("business_impact"))


def metric_alert(metric, threshold: float = C.LATENCY_ALERT_THRESHOLD, name: str = "latency") -> Column:
    """SCL13: a warning struct when the metric ``name`` exceeds the threshold."""
    m = _col(metric)
    return F.when(m > F.lit(threshold), F.struct(
        F.lit("warning").alias("level"),
        F.lit(f"{name} above {threshold}").alias("message"),
        m.alias("value")))


def cents(c) -> Column:
    """Money with two decimals as an exact integer number of cents."""
    return F.round(_col(c) * F.lit(100.0)).cast("long")


def money_mean(c) -> Column:
    """Mean of a money column, rounded half up to the cent.

    The sum is taken over integer cents, so it is exact in any order; only one
    division remains, which every engine does identically.
    """
    ce = cents(c)
    return F.floor(F.sum(ce) / F.count(ce) + F.lit(0.5)) / F.lit(100.0)
