"""Streaming jobs that keep state: profiles with a life, review triggers,
incremental neighbours, incremental report, lag (STR4-STR6, STR9)."""

import collections
import os
import tempfile
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shoplens.operators import events as E
from shoplens.operators import profiles as P
from shoplens.operators import recommend as RC
from shoplens.sources import tables as T
from shoplens.streaming import jobs as J
from shoplens.streaming import lag as L
from shoplens.streaming import neighbours as N
from shoplens.streaming import report as R
from shoplens.streaming import state as ST
from tests.conftest import SF_SMALL

REVIEW_SCHEMA = "event_id string, user_id string, product_id string, rating string, timestamp timestamp"
ACTION_SCHEMA = "event_id string, user_id string, product_id string, action string, timestamp timestamp"


def folder():
    return tempfile.mkdtemp(prefix="shoplens-state-")


def reviews(spark):
    rv = E.review_events(T.review_rows(spark, SF_SMALL), T.REVIEW_SOURCE_NAME, "row_index")
    # ratings that are missing or no number exercise the stale average
    rating = F.when(F.col("row_index") % 7 == 0, "n/a").when(F.col("row_index") % 11 != 0, F.col("rating"))
    user = F.when(F.col("row_index") % 13 == 0, "").otherwise((F.col("row_index") % 9).cast("string"))
    return rv.withColumns({"rating": rating, "user_id": user, "timestamp": F.col("timestamp").cast("timestamp")}) \
        .select("event_id", "user_id", "product_id", "rating", "timestamp")


def actions(spark):
    return T.actions(spark, SF_SMALL).withColumn("timestamp", F.col("timestamp").cast("timestamp")) \
        .select("event_id", "user_id", "product_id", "action", "timestamp")


def in_time_order(df, parts, at):
    """The rows as ``parts`` files that follow each other in time, below ``at``."""
    rows = df.orderBy("timestamp", "event_id").collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        one_file(df.sparkSession, rows[i * step:(i + 1) * step], df.schema, at, i)
    return at


def one_file(spark, rows, schema, at, i):
    os.makedirs(at, exist_ok=True)
    pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{at}/{i:03d}.parquet")
    os.utime(f"{at}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def run(df, each, checkpoint, mode="append"):
    q = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    assert q.awaitTermination(300)


@pytest.mark.parametrize("key", ["user_id", "product_id"])
def test_running_profiles_equal_batch(spark, key):
    rv, act = reviews(spark), actions(spark)
    base, latest = folder(), {}

    def each(batch, batch_id):
        for r in batch.collect():
            latest[r[key]] = r

    rs = J.file_event_stream(spark, in_time_order(rv, 3, f"{base}/r"), REVIEW_SCHEMA, max_files=1)
    acts = J.file_event_stream(spark, in_time_order(act, 3, f"{base}/a"), ACTION_SCHEMA, max_files=1)
    run(ST.running_profiles(rs, acts, key), each, f"{base}/c", "update")
    make, partners = (P.user_profiles, "products_count") if key == "user_id" else (P.product_profiles, "unique_users")
    want = {r[key]: r for r in make(rv, act).collect()}
    assert set(latest) == set(want)
    for k, w in want.items():
        g = latest[k]
        assert (g.reviews, g.interactions, g[partners], g.expired) == (w.reviews, w.interactions, w[partners], False)
        assert g.total_rating == pytest.approx(w.total_rating) and g.avg_rating == pytest.approx(w.avg_rating)


def test_profiles_expire_after_their_life(spark):
    base, seen = folder(), []
    schema = spark.createDataFrame([], REVIEW_SCHEMA).schema
    t = spark.sql("select timestamp'2024-01-01 00:00:00' t").first()[0]
    none = J.file_event_stream(spark, in_time_order(actions(spark).limit(0), 1, f"{base}/a"), ACTION_SCHEMA)
    os.makedirs(f"{base}/r")
    rs = J.file_event_stream(spark, f"{base}/r", REVIEW_SCHEMA, max_files=1)

    def wait_for(found, seconds=120):
        for _ in range(seconds * 5):
            if found():
                return True
            time.sleep(0.2)

    # timers need batches without data: this query ends by stop() only
    q = ST.running_profiles(rs, none, "user_id", ttl_ms=6_000).writeStream.outputMode("update") \
        .foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{base}/c") \
        .trigger(processingTime="500 milliseconds").start()
    try:
        one_file(spark, [("e0", "u", "p", "4", t), ("e1", "u", "q", "2", t), ("e2", "v", "p", "5", t)], schema, f"{base}/r", 0)
        assert wait_for(lambda: sum(r.expired for r in seen) == 2)
        first = [(r.user_id, r.reviews, r.products_count, r.avg_rating) for r in seen if not r.expired]
        assert sorted(first) == [("u", 2, 2, 3.0), ("v", 1, 1, 5.0)]
        assert sorted((r.user_id, r.reviews) for r in seen if r.expired) == [("u", 2), ("v", 1)]
        seen.clear()
        one_file(spark, [("e4", "u", "p", "1", t)], schema, f"{base}/r", 1)  # starts from nothing
        assert wait_for(lambda: any(not r.expired for r in seen))
        assert [(r.user_id, r.reviews, r.products_count, r.avg_rating) for r in seen if not r.expired] == [("u", 1, 1, 1.0)]
    finally:
        q.stop()


def test_one_trigger_for_every_tenth_review_with_restart(spark):
    rv, base = reviews(spark), folder()
    rows = rv.orderBy("timestamp", "event_id").collect()
    cuts = [0, 3, 4, 60, len(rows)]
    got = []
    stream = None
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):  # a run, then a new query on the same checkpoint, ...
        one_file(spark, rows[a:b], rv.schema, f"{base}/r", i)
        stream = stream or J.file_event_stream(spark, f"{base}/r", REVIEW_SCHEMA, max_files=1)
        run(N.review_triggers(stream, 10), lambda batch, _: got.extend(batch.collect()), f"{base}/c")
    want = collections.Counter(r.user_id for r in rows if r.user_id)
    triggers = sorted((r.user_id, r.review_number) for r in got if r.review_number)
    assert triggers == sorted((u, m) for u, n in want.items() for m in range(10, n + 1, 10)) and triggers
    by_user = collections.defaultdict(list)
    for r in rows:
        by_user[r.user_id].append(r.event_id)
    assert all(r.event_id == by_user[r.user_id][r.review_number - 1] for r in got if r.review_number)
    pairs = [(r.user_id, r.product_id) for r in got if r.product_id]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(r.user_id, r.product_id) for r in rows if r.user_id and r.product_id}
    with pytest.raises(ValueError):
        N.review_triggers(stream, 0)


def test_neighbour_index_equals_recompute(spark):
    acts = actions(spark).select("user_id", "product_id", "timestamp", "event_id")
    rows = acts.orderBy("timestamp", "event_id").collect()
    parts = [rows[:40], rows[40:90], rows[40:90], rows[90:]]  # the third repeats the second
    index, seen = N.NeighbourIndex(spark, folder(), buckets=4, merge_every=3), []
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part, acts.schema)
        index.add(batch, i)
        index.add(batch, i)  # delivered again
        seen += part
        sets = RC.interaction_sets(spark.createDataFrame(seen, acts.schema))
        near = RC.user_neighbours(sets)
        assert sorted(map(tuple, index.neighbours(i).collect())) == sorted(map(tuple, near.collect()))
        users = batch.select("user_id").where("user_id is not null").distinct()
        want = RC.neighbour_recommendations(sets, near).join(users, "user_id", "left_semi")
        cols = ["user_id", "product_id", "score", "rank"]
        assert sorted(map(tuple, index.recommend(i, users).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    repeated = index.pairs._read(["batch_id=2"])
    assert repeated.count() == 0  # no new pair, nothing to add


def test_index_reads_only_the_buckets_of_the_batch(spark):
    index = N.NeighbourIndex(spark, folder(), buckets=16)
    many = spark.range(400).select((F.col("id") % 50).cast("string").alias("user_id"), (F.col("id") % 37).cast("string").alias("product_id"))
    index.add(many, 0)
    few = spark.createDataFrame([("3",)], "user_id string")
    rows = index.pairs.upto(0, index.pairs.buckets_of(few, "user_id"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) > 1  # what lies there
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_recommendation_job_serves_triggered_users(spark):
    rv, base = reviews(spark), folder()
    stream = J.file_event_stream(spark, in_time_order(rv, 3, f"{base}/r"), REVIEW_SCHEMA, max_files=1)
    job = N.recommendation_job(spark, f"{base}/out", merge_every=2)
    run(N.review_triggers(stream, 5), job, f"{base}/c")
    last = job.rows.last_batch()
    served = job.recommendations.upto(last)
    triggers = job.rows.upto(last).where("review_number is not null")
    assert served.count() > 0
    assert served.join(triggers, ["user_id", "batch_id"], "left_anti").count() == 0
    sets = RC.interaction_sets(rv)
    want = RC.neighbour_recommendations(sets, RC.user_neighbours(sets))
    final = served.where(F.col("batch_id") == last).drop("batch_id")
    assert final.count() > 0 and final.join(want, ["user_id", "product_id", "score", "rank"], "left_anti").count() == 0


def test_incremental_report_equals_batch(spark):
    rv, act, base = reviews(spark), actions(spark), folder()
    events = rv.withColumns({"kind": F.lit("review"), "action": F.lit(None).cast("string")}).unionByName(
        act.withColumns({"kind": F.lit("interaction"), "rating": F.lit(None).cast("string")}))
    # reviews in time order over the batches, interactions anywhere
    stream = J.file_event_stream(spark, in_time_order(events, 4, f"{base}/e"), REVIEW_SCHEMA + ", kind string, action string", max_files=1)
    job = R.report_job(spark, f"{base}/out", every=25, merge_every=2)
    run(stream, job, f"{base}/c")
    last = job.report.totals.last_batch()
    assert last == 3
    got, want = job.report.summary(last).first(), P.processing_summary(rv, act).first()
    assert tuple(got)[:3] == tuple(want)[:3]
    for c in ("unique_users", "unique_products"):
        assert abs(got[c] - want[c]) <= 0.03 * want[c] + 1
    for key, make, partners in (("user_id", P.user_profiles, "products_count"), ("product_id", P.product_profiles, "unique_users")):
        g = {r[key]: r for r in job.report.profiles(last, key).collect()}
        w = {r[key]: r for r in make(rv, act).collect()}
        assert set(g) == set(w)
        for k in w:
            assert (g[k].reviews, g[k].interactions) == (w[k].reviews, w[k].interactions)
            assert g[k].total_rating == pytest.approx(w[k].total_rating) and g[k].avg_rating == pytest.approx(w[k].avg_rating)
            assert abs(g[k][partners] - w[k][partners]) <= 0.1 * w[k][partners] + 1
    docs = spark.read.json(f"{base}/out/reports")
    assert docs.where(f"batch_id = {last}").first().processing_summary.files_stored == want.files_stored
    before = job.report.summary(last).first()
    job(spark.read.parquet(f"{base}/e/003.parquet"), 3)  # delivered again
    assert job.report.summary(last).first() == before


def test_offset_lag_reads_nested_and_plain_offsets():
    assert L.offset_lag('{"t":{"0":5,"1":7}}', '{"t":{"0":9,"1":7}}') == 4
    assert L.offset_lag('{"logOffset":2}', '{"logOffset":5}') == 3
    assert L.offset_lag('{"logOffset":2}', None) is None and L.offset_lag(None, "7") is None
    assert L.offset_lag("3", "10") == 7 and L.offset_lag("no json", "1") is None and L.offset_lag("{}", "1") is None


def test_metrics_table_and_file_backlog(spark):
    base, act = folder(), actions(spark)
    src = in_time_order(act, 4, f"{base}/a b")
    sizes = [spark.read.parquet(f"{src}/{i:03d}.parquet").count() for i in range(4)]
    assert {r.rows for r in L.file_backlog(spark, src, f"{base}/c", ACTION_SCHEMA).collect()} == set(sizes)
    writer = L.MetricsWriter(spark, f"{base}/metrics")
    spark.streams.addListener(writer)
    try:
        stream = L.observed_counts(J.file_event_stream(spark, src, ACTION_SCHEMA, max_files=1))
        left = []

        def each(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{base}/o/{batch_id}")
            left.append(sum(r.rows for r in L.file_backlog(spark, src, f"{base}/c", ACTION_SCHEMA).collect()))

        run(stream, each, f"{base}/c")
        for _ in range(50):
            if len([f for f in os.listdir(f"{base}/metrics") if f.endswith(".json")] if os.path.isdir(f"{base}/metrics") else []) >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(writer)
    assert left == [sum(sizes[i + 1:]) for i in range(4)]
    m = L.read_metrics(spark, f"{base}/metrics").where("input_rows > 0")
    assert [r.input_rows for r in m.orderBy("batch_id").collect()] == sizes
    assert [int(r.observed["events.rows"]) for r in m.orderBy("batch_id").collect()] == sizes
    assert m.where("end_offset is null").count() == 0
