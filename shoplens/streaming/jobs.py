"""Structured Streaming jobs (STR1-STR3, STR7, STR8, STR10).

Every step is a streaming DataFrame with checkpointed state; the jobs that hold
state of their own lie beside this module.

STR1  stateless enrichment (same column functions as batch)
STR2  watermarked tumbling-window metrics
STR3  session windows
STR4  running user and product profiles: ``streaming.state``
STR5  review triggers and incremental neighbours: ``streaming.neighbours``
STR6  incremental analytics report: ``streaming.report``
STR7  bounded runs with ``availableNow`` and ``maxFilesPerTrigger``
STR8  per-user recommendation feed numbering
STR9  lag and throughput: ``streaming.lag``
STR10 duplicate and late events: watermark + ``dropDuplicatesWithinWatermark``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions import scalars as S
from shoplens.operators import behavior as B
from shoplens.operators import events as E


def file_event_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet",
                      max_files: int | None = None) -> DataFrame:
    """STR7 source: files of ``folder`` as a stream, all new ones per batch
    unless ``max_files`` limits them."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)


def with_event_time(stream: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Watermarks need a session-zone timestamp; local-time columns are
    converted (the session zone is UTC, so instants are unchanged)."""
    if stream.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream


def dedupe_events(stream: DataFrame, watermark: str = "10 minutes", ts: str = "timestamp",
                  key: str = "event_id") -> DataFrame:
    """STR10: drop repeated event ids while they can still arrive; rows older
    than the watermark are dropped by the state operator and counted in the
    query progress (``numRowsDroppedByWatermark``).  An event without an id is
    known by a hash of its whole row, so different ones all stay."""
    s = with_event_time(stream, ts)
    known = s.withColumn("_event_key", E.event_key(s, key))
    return known.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["_event_key"]).drop("_event_key")


def enrich_interaction_stream(stream: DataFrame) -> DataFrame:
    """STR1 for interactions; the processing id is derived from the event id."""
    return E.hashed_processing_ids(E.enrich_interactions(stream), C.INTERACTION_PROCESSING_PREFIX)


def enrich_review_stream(stream: DataFrame) -> DataFrame:
    """STR1 for reviews."""
    return E.hashed_processing_ids(E.enrich_reviews(stream), C.REVIEW_PROCESSING_PREFIX)


def window_metrics_stream(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes",
                          threshold: float = 180.0, slide: str | None = None) -> DataFrame:
    """STR2: per tumbling (or, with ``slide``, sliding) window, emitted once
    the watermark passes its end: approximate active users, events,
    conversion, average order value, alert."""
    a = F.col("action")
    win = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    g = (with_event_time(stream).withWatermark("timestamp", watermark)
         .groupBy(win.alias("w"))
         .agg(F.approx_count_distinct("user_id").alias("active_users"),
              F.count(F.lit(1)).alias("events"),
              F.count_if(a == "view").alias("views"), F.count_if(a == "purchase").alias("purchases"),
              S.money_mean(F.when(a == "purchase", F.col("value"))).alias("aov")))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "active_users", "events",
                    F.try_divide(F.col("purchases"), F.col("views")).alias("conversion"),
                    F.col("aov").alias("average_order_value"),
                    S.metric_alert(F.col("aov"), threshold).getField("level").alias("alert"))


def session_stream(stream: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """STR3: 30-minute-gap sessions per user, emitted when closed."""
    return B.user_sessions(with_event_time(stream).withWatermark("timestamp", watermark), gap)


def recommendation_feed(recs: DataFrame) -> DataFrame:
    """STR8: number each user's recommendations as a feed (stream_id)."""
    w = Window.partitionBy("user_id").orderBy("rank")
    return recs.withColumn("stream_id", F.row_number().over(w))
