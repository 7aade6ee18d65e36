"""Stream == batch: the streaming jobs over file streams of the given events."""

import tempfile

from pyspark.sql import functions as F

from shoplens.operators import behavior as B
from shoplens.operators import events as E
from shoplens.sources import tables as T
from shoplens.streaming import jobs as J
from tests.conftest import SF_SMALL

ACTION_SCHEMA = ("event_id string, user_id string, product_id string, action string, "
                 "timestamp timestamp_ntz, source string, original_rating double, confidence double")


def write_parts(df, n):
    folder = tempfile.mkdtemp(prefix="shoplens-stream-")
    df.repartition(n).write.mode("overwrite").parquet(folder)
    return folder


def run_to_memory(stream_df, name, mode="append"):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    return q


def test_enrichment_stream_equals_batch(spark):
    acts = T.actions(spark, SF_SMALL)
    folder = write_parts(acts, 4)
    stream = J.file_event_stream(spark, folder, ACTION_SCHEMA, max_files=1)
    run_to_memory(J.enrich_interaction_stream(stream).drop("processed_at"), "enriched_stream")
    got = spark.table("enriched_stream")
    exp = E.hashed_processing_ids(E.enrich_interactions(acts), "int_proc_").drop("processed_at")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_dedupe_drops_repeats(spark):
    acts = T.actions(spark, SF_SMALL)
    doubled = acts.unionByName(acts.limit(50))
    folder = write_parts(doubled, 3)
    stream = J.file_event_stream(spark, folder, ACTION_SCHEMA, max_files=10)
    run_to_memory(J.dedupe_events(stream, "1 day"), "dedupe_stream")
    assert spark.table("dedupe_stream").count() == acts.count()


def test_window_and_session_streams_equal_batch(spark):
    ev = T.events_with_value(spark, SF_SMALL)
    folder = write_parts(ev, 2)
    schema = "event_id long, timestamp timestamp_ntz, user_id long, action string, value double, product_id string"
    stream = J.file_event_stream(spark, folder, schema, max_files=10)
    run_to_memory(J.window_metrics_stream(stream, "1 hour", "1 hour"), "window_stream")
    got = spark.table("window_stream")
    # append mode emits a window once the watermark (max time - 1 hour) passes its end
    last = ev.agg(F.max("timestamp")).first()[0]
    import datetime as dt
    closed = B.window_metrics(ev, "1 hour").where(
        F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last - dt.timedelta(hours=1)))
    cols = ["window_start", "active_users", "events", "average_order_value", "alert"]
    assert got.count() == closed.count()
    assert got.select(cols).exceptAll(closed.select(cols)).count() == 0
    stream2 = J.file_event_stream(spark, folder, schema, max_files=10)
    run_to_memory(J.session_stream(stream2, "30 minutes", "1 hour"), "session_stream")
    exp = B.user_sessions(ev).where(F.col("session_end") <= F.lit(last - dt.timedelta(hours=1)))
    got_s = spark.table("session_stream")
    assert got_s.count() == exp.count()
    assert got_s.exceptAll(exp).count() == 0


def test_sliding_window_stream_equals_batch(spark):
    import datetime as dt
    ev = T.events_with_value(spark, SF_SMALL)
    folder = write_parts(ev, 2)
    schema = "event_id long, timestamp timestamp_ntz, user_id long, action string, value double, product_id string"
    stream = J.file_event_stream(spark, folder, schema, max_files=10)
    run_to_memory(J.window_metrics_stream(stream, "1 hour", "1 hour", slide="30 minutes"), "sliding_stream")
    last = ev.agg(F.max("timestamp")).first()[0]
    closed = B.window_metrics(ev, "1 hour", slide="30 minutes").where(
        F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last - dt.timedelta(hours=1)))
    cols = ["window_start", "active_users", "events", "average_order_value", "alert"]
    got = spark.table("sliding_stream").select(cols)
    assert got.count() == closed.count()
    assert got.exceptAll(closed.select(cols)).count() == 0
