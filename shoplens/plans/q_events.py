"""Event construction and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.operators import events as E
from shoplens.plans.registry import register
from shoplens.plans import sqlparts as Q
from shoplens.sources import tables as T
from shoplens.sources.topics import INTERACTION_TOPIC, REVIEW_TOPIC


def reviews(spark, sf_dir):
    """Review events (PRJ3-PRJ6) built from the documents table."""
    return E.review_events(T.review_rows(spark, sf_dir), T.REVIEW_SOURCE_NAME, "row_index")


def interactions(spark, sf_dir):
    """UDT1 interactions derived from the reviews."""
    return E.interactions_from_reviews(reviews(spark, sf_dir))


_META_COUNT = "(" + " + ".join(f"(CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END)" for c in ("lang", "source", "n_chars")) + ")"


@register("review_events", f"""WITH {Q.REVIEWS_CTE}
SELECT event_id, '{C.REVIEW_EVENT_TYPE}' AS event_type, 'documents' AS dataset_source, row_index, timestamp,
       user_id, product_id, rating, review_text, CAST(NULL AS VARCHAR) AS helpful,
       CAST(NULL AS VARCHAR) AS title, lang AS meta_lang, source AS meta_source, n_chars AS meta_n_chars,
       user_id AS kafka_key
FROM reviews""")
def q_review_events(spark, sf_dir):
    """PRJ3 + PRJ4 + PRJ5 + PRJ6."""
    ev = reviews(spark, sf_dir)
    return ev.select("event_id", "event_type", "dataset_source", "row_index", "timestamp",
                     "user_id", "product_id", "rating", "review_text", "helpful", "title",
                     F.col("metadata")["lang"].alias("meta_lang"),
                     F.col("metadata")["source"].alias("meta_source"),
                     F.col("metadata")["n_chars"].alias("meta_n_chars"), "kafka_key")


@register("positional_review_events", f"""WITH {Q.REVIEWS_CTE}
SELECT event_id, user_id, product_id, rating, lang AS meta_d FROM reviews""")
def q_positional_review_events(spark, sf_dir):
    """PRJ4: no column has a known name, so the first three are user, product and rating; the fourth is metadata."""
    rows = T.review_rows(spark, sf_dir).select(F.col("user_id").alias("a"), F.col("product_id").alias("b"),
                                               F.col("rating").alias("c"), F.col("lang").alias("d"), "row_index")
    return E.review_events(rows, T.REVIEW_SOURCE_NAME, "row_index").select(
        "event_id", "user_id", "product_id", "rating", F.col("metadata")["d"].alias("meta_d"))


@register("review_enriched", f"""WITH {Q.REVIEWS_CTE}
SELECT event_id, user_id, product_id, rating,
       CAST(length(coalesce(review_text, '')) AS INTEGER) AS review_length,
       {Q.sentiment_columns('review_text')},
       {Q.recommendation_weight('rating', 'review_text')} AS recommendation_weight,
       {Q.quality_score('rating', 'review_text', _META_COUNT)} AS quality_score,
       printf('csv_proc_%06d', row_number() OVER (ORDER BY timestamp, event_id)) AS processing_id
FROM reviews""")
def q_review_enriched(spark, sf_dir):
    """STR1 review enrichment: SCL1, SCL2, SCL3, SCL5, PRJ7."""
    ev = E.enrich_reviews(reviews(spark, sf_dir))
    s = F.col("sentiment_analysis")
    # project before numbering so the sort does not carry the review text
    ev = ev.select("event_id", "timestamp", "user_id", "product_id", "rating", "review_length",
                   s.score.alias("sentiment_score"), s.confidence.alias("sentiment_confidence"),
                   s.positive_words.alias("positive_words"), s.negative_words.alias("negative_words"),
                   "recommendation_weight", "quality_score")
    return E.with_processing_ids(ev, C.REVIEW_PROCESSING_PREFIX, ["timestamp", "event_id"]).drop("timestamp")


_UDT1_SQL = f"""WITH {Q.REVIEWS_CTE},
r AS (SELECT row_index, user_id, product_id, {Q.rating_value('rating')} AS original_rating,
             timestamp FROM reviews),
x AS (
  SELECT r.*, 0 AS pos, 'view' AS action FROM r
  UNION ALL SELECT r.*, 1, 'click' FROM r WHERE original_rating >= 3
  UNION ALL SELECT r.*, 2, 'cart_add' FROM r WHERE original_rating >= 4
  UNION ALL SELECT r.*, 3, 'purchase' FROM r WHERE original_rating >= 4
  UNION ALL SELECT r.*, 4, 'like' FROM r WHERE original_rating >= 4.5)
SELECT printf('interaction_%06d', row_number() OVER (ORDER BY row_index, pos) - 1) AS event_id,
       user_id, product_id, action, timestamp, 'csv_derived' AS source, original_rating,
       CASE WHEN original_rating >= 4 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM x"""


@register("interaction_events", _UDT1_SQL)
def q_interaction_events(spark, sf_dir):
    """UDT1 + SCL6 + SCL7: reviews exploded into interaction events."""
    return interactions(spark, sf_dir)


@register("interaction_enriched", f"""WITH {Q.ACTIONS_CTE}
SELECT event_id, user_id, product_id, action, {Q.weight('action')}::DOUBLE AS action_weight,
       coalesce(action IN ('purchase', 'like', 'cart_add'), false) AS recommendation_trigger,
       row_number() OVER (ORDER BY timestamp, event_id) AS sequence_number,
       printf('int_proc_%06d', row_number() OVER (ORDER BY timestamp, event_id)) AS processing_id
FROM actions""")
def q_interaction_enriched(spark, sf_dir):
    """STR1 interaction enrichment: SCL4, FLT2, PRJ7, WIN3 over the events table."""
    ev = E.enrich_interactions(T.actions(spark, sf_dir))
    ev = E.with_processing_ids(ev, C.INTERACTION_PROCESSING_PREFIX, ["timestamp", "event_id"],
                               with_sequence=True)
    return ev.select("event_id", "user_id", "product_id", "action", "action_weight",
                     "recommendation_trigger", "sequence_number", "processing_id")


def api_events(spark, sf_dir):
    """SRC11: the events table as API event JSON documents, decoded with the
    declared schema (what a batch or stream of posted events looks like)."""
    ev = T.read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    doc = F.to_json(F.struct(F.col("user_id"), F.col("event_type").alias("action"),
                             F.get_json_object("props", "$.k").alias("product_id"),
                             F.col("ts").cast("string").alias("timestamp")))
    return ev.select("event_id", E.decode_api_events(doc).alias("e")).select("event_id", "e.*")


_API_SQL_BASE = """api AS (
  SELECT event_id, user_id, event_type AS action, json_extract_string(props, '$.k') AS product_id
  FROM events),
p AS (
  SELECT event_id, user_id, action, product_id,
         coalesce(action IN ('view', 'purchase', 'like'), false) AS recommendations_triggered,
         CASE WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'view' THEN 'high'
              WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'purchase' THEN 'critical'
              WHEN action IN ('like', 'share') THEN 'medium' END AS action_priority,
         CASE WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'view' THEN NULL
              WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'purchase'
                   THEN 'recommendation_update,user_model_retrain'
              WHEN action IN ('like', 'share') THEN 'preference_update' END AS triggers,
         CASE WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'view' THEN NULL
              WHEN user_id IS NOT NULL AND user_id <> 0 AND action = 'purchase' THEN 'high'
              WHEN action IN ('like', 'share') THEN 'medium' END AS business_impact
  FROM api)"""


@register("api_event_processing", f"""WITH {_API_SQL_BASE}
SELECT event_id, user_id, action, product_id, recommendations_triggered, action_priority,
       triggers, business_impact FROM p""")
def q_api_event_processing(spark, sf_dir):
    """SRC11 + SCL11 + FLT3 + SCL12."""
    p = E.process_api_events(api_events(spark, sf_dir))
    return p.select("event_id", "user_id", "action", "product_id", "recommendations_triggered",
                    "action_priority", F.array_join("triggers", ",").alias("triggers"),
                    "business_impact")


@register("api_event_summary", f"""WITH {_API_SQL_BASE}
SELECT count(*) FILTER (WHERE action = 'view') AS view_events,
       count(*) FILTER (WHERE action = 'purchase') AS purchase_events,
       count(*) FILTER (WHERE action = 'like') AS like_events,
       count(*) FILTER (WHERE recommendations_triggered) AS total_recommendations_triggered,
       count(*) FILTER (WHERE action_priority IN ('high', 'critical')) AS high_priority_events,
       count(*) AS events_processed
FROM p""")
def q_api_event_summary(spark, sf_dir):
    """AGG9."""
    return E.api_event_summary(E.process_api_events(api_events(spark, sf_dir)))


@register("topic_records", f"""WITH {Q.ACTIONS_CTE}
SELECT coalesce(user_id, 'user_' || event_id) AS key,
       '{{"event_id":"' || event_id || '","product_id":"' || product_id || '","action":"' || action || '"}}' AS value
FROM actions""")
def q_topic_records(spark, sf_dir):
    """SNK4 projection: keyed JSON records ready for a topic (key = user id)."""
    acts = T.actions(spark, sf_dir).withColumn(
        "key", F.coalesce(F.col("user_id"), F.concat(F.lit("user_"), F.col("event_id"))))
    return E.to_topic_records(acts, "key", ["event_id", "product_id", "action"])


def topic_events(spark, sf_dir):
    """Reviews and actions as one table of records with their topic."""
    rv = reviews(spark, sf_dir).select(F.lit(REVIEW_TOPIC).alias("topic"), "event_id", "user_id", "product_id", "rating")
    ac = T.actions(spark, sf_dir).select(F.lit(INTERACTION_TOPIC).alias("topic"), "event_id", "user_id", "product_id",
                                         "action")
    return E.append_datasets(rv, ac)


_TOPIC_EVENTS = f"""WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE},
topic_events AS (
  SELECT '{REVIEW_TOPIC}' AS topic, event_id, user_id, product_id, rating, CAST(NULL AS VARCHAR) AS action FROM reviews
  UNION ALL
  SELECT '{INTERACTION_TOPIC}', event_id, user_id, product_id, CAST(NULL AS VARCHAR), action FROM actions)"""


@register("appended_events", f"{_TOPIC_EVENTS} SELECT * FROM topic_events")
def q_appended_events(spark, sf_dir):
    """SET2: reviews and actions appended by column name, missing columns null."""
    return topic_events(spark, sf_dir)


@register("routed_events", f"""{_TOPIC_EVENTS}
SELECT event_id, user_id, product_id, action FROM topic_events WHERE topic = '{INTERACTION_TOPIC}'""")
def q_routed_events(spark, sf_dir):
    """FLT4: the records of the interaction topic."""
    return E.route_by_topic(topic_events(spark, sf_dir), INTERACTION_TOPIC) \
        .select("event_id", "user_id", "product_id", "action")


_KINDS = ["recommendations", "similar", "trending", "category"]


@register("bounded_requests", f"""WITH r AS (SELECT event_id, CASE event_id % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind,
  CASE WHEN user_id IS NOT NULL THEN (event_id * 7) % 120 END AS wanted FROM events)
SELECT event_id, kind, wanted, coalesce(CASE kind {' '.join(f"WHEN '{k}' THEN wanted BETWEEN {lo} AND {hi}" for k, (lo, hi) in C.LIMIT_BOUNDS.items())} END, false) AS accepted
FROM r""")
def q_bounded_requests(spark, sf_dir):
    """FLT7: requests derived from the events, each held against the bounds of its kind."""
    from shoplens.operators.trending import within_bounds
    ev = T.read_table(spark, sf_dir, "events", ["event_id", "user_id"])
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 5).cast("int"))
    wanted = F.when(F.col("user_id").isNotNull(), (F.col("event_id") * 7) % 120)
    return ev.select("event_id", kind.alias("kind"), wanted.alias("wanted")).withColumn(
        "accepted", within_bounds(F.col("kind"), F.col("wanted")))
