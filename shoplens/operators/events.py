"""Event construction and enrichment: reviews, interactions, API events.

PRJ3/PRJ4  canonical-column resolution with positional fallback (driver-side,
           over ``df.columns`` only; emits a ``select``)
PRJ5/PRJ6  review event build with metadata map and key defaults
PRJ7       envelope (processed_at, processing_id, sequence_number)
STR1       stateless enrichment; the same functions run on streams
UDT1       review -> interaction events (one row -> many)
SRC11      API event decode; SCL11/FLT3 API event processing; AGG9 summary
FLT4       topic routing
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens import schemas
from shoplens.functions import scalars as S
from shoplens.operators.sequence import with_global_sequence

CANONICAL_ORDER = list(C.CANONICAL_COLUMNS)


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """PRJ3: canonical name -> source column; the first alias present wins
    (case-sensitive).  PRJ4: when nothing resolves, columns 0, 1, 2 are user,
    product and rating."""
    found = {}
    for canon, aliases in C.CANONICAL_COLUMNS.items():
        for alias in aliases:
            if alias in columns:
                found[canon] = alias
                break
    if not found:
        for canon, pos in (("user_id", 0), ("product_id", 1), ("rating", 2)):
            if len(columns) > pos:
                found[canon] = columns[pos]
    return found


def review_events(rows: DataFrame, source_name: str, index_col: str,
                  mapping: dict[str, str] | None = None) -> DataFrame:
    """PRJ5/PRJ6: one review event per source row.

    Canonical columns are stringified (nulls stay null); every other non-null
    column goes into the ``metadata`` map.  ``timestamp`` is the source's own
    time column when there is one, else the arrival time; ``processing_time``
    is the arrival time.  ``kafka_key`` is the user id, else ``user_{idx}``.
    """
    cols = [c for c in rows.columns if c != index_col]
    mapping = mapping or resolve_columns(cols)
    used = set(mapping.values())
    idx = F.col(index_col)
    arrival = F.current_timestamp().cast("timestamp_ntz")
    out = [
        F.concat(F.lit(f"{C.REVIEW_EVENT_ID_PREFIX}{source_name}_"), idx.cast("string")).alias("event_id"),
        F.lit(C.REVIEW_EVENT_TYPE).alias("event_type"),
        F.lit(source_name).alias("dataset_source"),
        idx.cast("long").alias("row_index"),
    ]
    if "timestamp" in mapping:
        event_time = F.coalesce(F.col(mapping["timestamp"]).cast("string").try_cast("timestamp_ntz"),
                                arrival)
    else:
        event_time = arrival
    out += [event_time.alias("timestamp"), arrival.alias("processing_time")]
    for canon in CANONICAL_ORDER:
        if canon == "timestamp":
            continue
        if canon in mapping:
            out.append(F.col(mapping[canon]).cast("string").alias(canon))
        else:
            out.append(F.lit(None).cast("string").alias(canon))
    meta_cols = [c for c in cols if c not in used]
    if meta_cols:
        pairs = []
        for c in meta_cols:
            pairs += [F.lit(c), F.col(c).cast("string")]
        meta = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    else:
        meta = F.create_map().cast("map<string,string>")
    out.append(meta.alias("metadata"))
    ev = rows.select(*out)
    return ev.withColumn("kafka_key", F.coalesce(F.col("user_id"),
                                                 F.concat(F.lit("user_"), F.col("row_index").cast("string"))))


def enrich_reviews(reviews: DataFrame) -> DataFrame:
    """STR1 (reviews): sentiment, length, recommendation weight, quality score.

    The word hits are computed in their own column first (one pass of the
    substring tests per row), then turned into the sentiment struct.
    """
    staged = reviews.withColumn("_sentiment_counts", S.sentiment_counts("review_text"))
    return staged.select(
        *reviews.columns,
        F.current_timestamp().cast("timestamp_ntz").alias("processed_at"),
        S.sentiment_from_counts("_sentiment_counts").alias("sentiment_analysis"),
        S.review_length("review_text").alias("review_length"),
        S.recommendation_weight("rating", "review_text").alias("recommendation_weight"),
        S.quality_score("rating", "review_text", "metadata").alias("quality_score"),
    )


def with_processing_ids(df: DataFrame, prefix: str, order_cols: list,
                        with_sequence: bool = False) -> DataFrame:
    """PRJ7/WIN3: ``processing_id`` = prefix + 6-digit arrival number.

    Batch: the global arrival number comes from a distributed sort (no
    single-partition window).  Streams use ``hashed_processing_ids`` instead.
    """
    out = with_global_sequence(df, order_cols, "sequence_number")
    out = out.withColumn("processing_id", F.format_string(prefix + "%06d", F.col("sequence_number")))
    return out if with_sequence else out.drop("sequence_number")


def hashed_processing_ids(df: DataFrame, prefix: str) -> DataFrame:
    """Stream form of PRJ7: a global counter cannot be kept across executors,
    so the id is the full 64-bit hash of the event's key (stable under replays)."""
    return df.withColumn("processing_id", F.concat(F.lit(prefix), F.lower(F.lpad(F.hex(
        F.xxhash64(event_key(df))), 16, "0"))))


def event_key(df: DataFrame, key: str = "event_id") -> F.Column:
    """The event id, or a hash of the whole row for an event without one.
    Columns that differ between deliveries of one event are left out."""
    fields = [c for c in df.columns if c not in (key, "processed_at", "processing_time")]
    return F.coalesce(F.concat(F.lit("id:"), F.col(key).cast("string")),
                      F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*fields)), 256)))


def interactions_from_reviews(reviews: DataFrame) -> DataFrame:
    """UDT1: every review becomes 1-5 interaction events (SCL6), numbered
    ``interaction_%06d`` in (row_index, position) order."""
    rated = reviews.select(
        "row_index",
        F.coalesce(F.col("user_id"), F.concat(F.lit("user_"), F.col("row_index").cast("string"))
                   ).alias("user_id"),
        F.coalesce(F.col("product_id"), F.concat(F.lit("prod_"), F.col("row_index").cast("string"))
                   ).alias("product_id"),
        S.rating_value("rating").alias("original_rating"),
        "timestamp",
    )
    exploded = rated.select("*", F.posexplode(S.rating_actions(F.col("original_rating")))
                            .alias("pos", "action"))
    numbered = with_global_sequence(exploded, ["row_index", "pos"], "_n")
    return numbered.select(
        F.format_string(C.INTERACTION_ID_FORMAT, F.col("_n") - 1).alias("event_id"),
        "user_id", "product_id", "action", "timestamp",
        F.lit(C.DERIVED_INTERACTION_SOURCE).alias("source"),
        "original_rating",
        S.interaction_confidence(F.col("original_rating")).alias("confidence"),
    )


def enrich_interactions(actions: DataFrame) -> DataFrame:
    """STR1 (interactions) / PRJ7: action weight and trigger flag."""
    return actions.select(
        "*",
        F.current_timestamp().cast("timestamp_ntz").alias("processed_at"),
        S.action_weight("action").alias("action_weight"),
        S.is_stream_trigger("action").alias("recommendation_trigger"),
    )


def decode_api_events(json_text) -> F.Column:
    """SRC11/SCL12: parse an API event JSON document with the declared schema."""
    return F.from_json(json_text, schemas.API_EVENT)


def process_api_events(events: DataFrame) -> DataFrame:
    """SCL11 + FLT3: priority, triggers, business impact, trigger flag."""
    pr = S.event_priority("user_id", "action")
    return events.select(
        "*",
        S.is_api_trigger("action").alias("recommendations_triggered"),
        pr.getField("action_priority").alias("action_priority"),
        pr.getField("triggers").alias("triggers"),
        pr.getField("business_impact").alias("business_impact"),
    )


def api_event_summary(processed: DataFrame) -> DataFrame:
    """AGG9: counts of views, purchases, likes, triggered and high/critical events."""
    return processed.agg(
        F.count_if(F.col("action") == "view").alias("view_events"),
        F.count_if(F.col("action") == "purchase").alias("purchase_events"),
        F.count_if(F.col("action") == "like").alias("like_events"),
        F.count_if(F.col("recommendations_triggered")).alias("total_recommendations_triggered"),
        F.count_if(F.col("action_priority").isin("high", "critical")).alias("high_priority_events"),
        F.count(F.lit(1)).alias("events_processed"),
    )


def route_by_topic(records: DataFrame, topic: str) -> DataFrame:
    """FLT4: the records of one topic (unknown topics are simply never selected)."""
    return records.where(F.col("topic") == F.lit(topic))


def to_topic_records(df: DataFrame, key_col: str, value_cols: list | None = None) -> DataFrame:
    """SNK4 projection: (key, value) with the value as a JSON document."""
    value_cols = value_cols or df.columns
    return df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*value_cols)).alias("value"))


def append_datasets(*frames: DataFrame) -> DataFrame:
    """SET2: UNION ALL by column name; columns missing in a frame are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
