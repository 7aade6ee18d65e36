"""Layers, the whole event job, content recommendations, encodings per file."""

import collections
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shoplens.operators import events as E
from shoplens.operators import profiles as P
from shoplens.operators import recommend as RC
from shoplens.sinks.layers import Layers
from shoplens.sources import files as FS
from shoplens.streaming import event_job as EJ
from shoplens.streaming import jobs as J
from tests.test_stream_state import ACTION_SCHEMA, REVIEW_SCHEMA, actions, folder, in_time_order, one_file, reviews

GOLD = ["date", "user_id", "reviews", "interactions", "rated", "total_rating", "action_weight"]


def gold(layers, area="user_profiles"):
    return sorted(tuple(r) for r in layers.read("gold", area).select(GOLD).collect())


def test_layers_take_batches_late_and_twice(spark):
    layers = Layers(spark, folder())
    t = [spark.sql(f"select timestamp'2024-01-0{d} 10:00:00' t").first()[0] for d in (1, 2, 3)]
    make = lambda rows: spark.createDataFrame(rows, REVIEW_SCHEMA)
    first = make([("a", "u", "p", "4", t[0]), ("b", " ", "p", "x", t[0]), ("c", "u", "q", None, t[1]), ("z", "u", "q", "1", None)])
    layers.process("reviews", first, 0)
    one = gold(layers)
    assert [(str(r[0]), *r[1:]) for r in one] == [("2024-01-01", "u", 1, 0, 1, 4.0, 0.0), ("2024-01-02", "u", 1, 0, 0, 0.0, 0.0)]
    layers.process("reviews", first, 0)  # again, as a whole
    assert gold(layers) == one and layers.read("bronze", "reviews").count() == 4
    late = make([("d", "u", "p", "2", t[0]), ("a", "u", "p", "4", t[0]), (None, "v", "p", "5", t[2]), (None, "v", "p", "5", t[2])])
    layers.process("reviews", late, 1)  # a late event, a repeated one, one without id twice
    got = {(str(r[0]), r[1]): r[2:] for r in gold(layers)}
    assert got == {("2024-01-01", "u"): (2, 0, 2, 6.0, 0.0), ("2024-01-02", "u"): (1, 0, 0, 0.0, 0.0),
                   ("2024-01-03", "v"): (1, 0, 1, 5.0, 0.0)}
    acts = spark.createDataFrame([("i", "u", "p", "purchase", t[0]), ("j", "w", "p", "view", t[0])], ACTION_SCHEMA)
    layers.process("interactions", acts, 2)
    got = {(str(r[0]), r[1]): r[2:] for r in gold(layers)}
    assert got["2024-01-01", "u"] == (2, 1, 2, 6.0, 5.0) and got["2024-01-01", "w"] == (0, 1, 0, 0.0, 1.0)
    assert got["2024-01-03", "v"] == (1, 0, 1, 5.0, 0.0)
    with pytest.raises(ValueError):
        layers.path("gold", "reviews")


def test_layers_leave_other_partitions_alone(spark):
    layers = Layers(spark, folder())
    t = [spark.sql(f"select timestamp'2024-01-0{d} 10:00:00' t").first()[0] for d in (1, 2)]
    layers.process("reviews", spark.createDataFrame([("a", "u", "p", "4", t[0])], REVIEW_SCHEMA), 0)
    at = f"{layers.path('gold', 'user_profiles')}/date=2024-01-01"
    before = {f: os.stat(f"{at}/{f}").st_mtime_ns for f in os.listdir(at)}
    layers.process("reviews", spark.createDataFrame([("b", "u", "p", "4", t[1])], REVIEW_SCHEMA), 1)
    assert {f: os.stat(f"{at}/{f}").st_mtime_ns for f in os.listdir(at)} == before


def test_layers_upsert_recommendations_and_keep_documents(spark):
    layers, schema = Layers(spark, folder()), "user_id string, product_id string, score double, rank int"
    for rows in ([("u", "p", 0.5, 1), ("u", "q", 0.4, 2), ("v", "p", 0.3, 1)], [("u", "r", 0.9, 1)], [("u", "r", 0.9, 1)]):
        layers.put_recommendations(spark.createDataFrame(rows, schema))
    got = sorted(tuple(r) for r in layers.read("gold", "recommendations").select("user_id", "product_id", "score", "rank").collect())
    assert got == [("u", "r", 0.9, 1), ("v", "p", 0.3, 1)]
    for batch_id in (0, 0, 1):
        layers.put_analytics(spark.createDataFrame([(batch_id, "x")], "n int, s string"), batch_id)
    assert layers.read("gold", "analytics").count() == 2


def test_event_job_equals_batch(spark):
    """Repeated, late and null-id events, over two bounded runs of the whole job."""
    base = folder()
    rv, act = reviews(spark), actions(spark)
    act = act.withColumn("event_id", F.when(F.col("event_id").cast("long") % 17 != 0, F.col("event_id")))
    acts = act.orderBy("timestamp").collect()
    rows = rv.orderBy("timestamp", "event_id").collect()
    job = EJ.EventJob(spark, f"{base}/job", every_reviews=5, every_events=25, watermark="365 days", merge_every=2)
    for i, (a, b) in enumerate((((0, 60), (0, 200)), ((60, None), (200, None)))):
        one_file(spark, rows[slice(*a)], rv.schema, f"{base}/r", i)
        one_file(spark, acts[slice(*b)] + acts[:20] * i, act.schema, f"{base}/a", i)  # the second run repeats 20 events
        rs = J.file_event_stream(spark, f"{base}/r", REVIEW_SCHEMA, max_files=1).withColumn("review_text", F.lit("good")) \
            .withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
        as_ = J.file_event_stream(spark, f"{base}/a", ACTION_SCHEMA, max_files=1)
        for q in job.start(rs, as_):
            assert q.awaitTermination(300) and q.exception() is None
    enriched = spark.read.json(f"{job.root}/interactions")
    assert enriched.count() == act.distinct().count()
    want = E.enrich_interactions(act.distinct())
    assert enriched.agg(F.sum("action_weight")).first()[0] == want.agg(F.sum("action_weight")).first()[0]
    assert spark.read.json(f"{job.root}/reviews").count() == rv.count()
    profiles = {r.product_id: r for r in EJ.latest(job.product_profiles, "product_id").collect()}
    for w in P.product_profiles(rv, act).collect():
        assert (profiles[w.product_id].reviews, profiles[w.product_id].unique_users) == (w.reviews, w.unique_users)
    last = job.report.report.totals.last_batch()
    summary = job.report.report.summary(last).first()
    assert summary.csv_reviews_processed == rv.count() and summary.interactions_processed == act.distinct().count()
    sets = RC.interaction_sets(rv)
    near = sorted(map(tuple, job.recommend.index.neighbours(job.recommend.rows.last_batch()).collect()))
    assert near == sorted(map(tuple, RC.user_neighbours(sets).collect()))
    assert EJ.served_recommendations(job.recommend.recommendations).count() > 0
    served = job.served.upto(job.served.last_batch())
    assert served.count() == act.count() + 20


def test_event_recommendation_stream_reads_a_fresh_static_side(spark):
    base = folder()
    schema = "event_id string, user_id string, action string"
    event = lambda i, *r: one_file(spark, r, spark.createDataFrame([], schema).schema, f"{base}/e", i)
    event(0, ("1", "u", "view"), ("2", None, "view"), ("3", "nobody", "view"), ("4", "u", "like"))
    event(1, ("5", "u", "view"))
    versions = [[("u", "p", 1)], [("u", "q", 1), ("u", "r", 2)]]
    calls = []

    def recs():
        calls.append(len(calls))
        return spark.createDataFrame(versions[min(calls[-1], 1)], "user_id string, product_id string, rank int")

    out = EJ.BatchTable(spark, f"{base}/out", EJ.SERVED)
    q = J.file_event_stream(spark, f"{base}/e", schema, max_files=1).writeStream.foreachBatch(
        EJ.event_recommendation_job(out, recs)).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.event_id: (r.recommendations_generated, r.top_recommendation) for r in out.upto(out.last_batch()).collect()}
    assert got == {"1": (1, "p"), "2": (None, None), "3": (0, None), "4": (None, None), "5": (2, "q")}


def test_content_recommendations_follow_taste_then_place(spark):
    dim = spark.createDataFrame([("a", "toys", 120.0), ("b", "toys", 130.0), ("c", "toys", 190.0), ("d", "books", 20.0),
                                 ("e", "books", 30.0), ("f", None, 30.0), ("g", "toys", None)],
                                "product_id string, category string, price double")
    acts = spark.createDataFrame([("u", "a", "purchase"), ("u", "d", "view"), ("v", "d", "like"), ("w", "f", "view"),
                                  ("", "a", "view"), ("x", None, "view")], "user_id string, product_id string, action string")
    pop = RC.popularity_scores(acts, dim)
    got = collections.defaultdict(list)
    for r in RC.content_recommendations(acts, dim, pop, 3).orderBy("user_id", "rank").collect():
        got[r.user_id].append((r.product_id, r.score))
    # u: 5 of 6 weight in toys 100-200, where a is seen; then the books
    assert dict(got) == {"u": [("b", 0.833333), ("c", 0.833333), ("e", 0.166667)], "v": [("e", 1.0)]}


def test_encoding_is_decided_file_by_file(spark):
    at = tempfile.mkdtemp(prefix="shoplens-enc-")
    for name, encoding, rows in (("a", "utf-8", "1,José\n2,漢字\n"), ("b", "latin-1", "3,Zürich\n4,plain\n"), ("c", "ascii", "5,x\n"),
                                 ("d", "utf-8", "")):
        with open(f"{at}/{name}.csv", "wb") as f:
            f.write(("id,city\n" + rows).encode(encoding))
    got = {r.id: r.city for r in FS.read_csv_any_encoding(spark, at, "id int, city string").collect()}
    assert got == {1: "José", 2: "漢字", 3: "Zürich", 4: "plain", 5: "x"}
    kinds = {os.path.basename(r.path): r.encoding for r in FS.file_encodings(spark, at).collect()}
    assert kinds == {"a.csv": "utf-8", "b.csv": "latin-1", "c.csv": "utf-8", "d.csv": "utf-8"}
