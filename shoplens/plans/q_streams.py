"""Streaming jobs over the given tables, run to the end of what is there.

Each query writes events derived from the tables as files below the shared
checkpoint folder, runs its job over them as a stream of several micro-batches
(one file each) and returns what the job left, which must equal the batch result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.plans import sqlparts as Q
from shoplens.plans.q_events import reviews
from shoplens.plans.q_recommend import neighbour_recs
from shoplens.plans.registry import ORACLE, register
from shoplens.session import scratch_path
from shoplens.sinks.layers import Layers
from shoplens.sources import tables as T
from shoplens.streaming import event_job as EJ
from shoplens.streaming import jobs as J
from shoplens.streaming import lag as L
from shoplens.streaming import neighbours as N
from shoplens.streaming import report as R
from shoplens.streaming.state import running_profiles
from shoplens.streaming.tables import BatchTable

FILES = 3
_REVIEWS = f"WITH {Q.REVIEWS_CTE}"


def _root(spark, sf_dir, name):
    return scratch_path(spark, os.path.join(os.path.basename(os.path.normpath(sf_dir)), uuid.uuid4().hex[:12], name))


def as_stream(df, folder, files=FILES):
    """The rows as a stream of ``files`` micro-batches."""
    typed = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    typed.repartition(files).write.parquet(folder)
    return J.file_event_stream(df.sparkSession, folder, typed.schema.simpleString()[7:-1].replace(":", " "), max_files=1)


def drain(stream, each, root, mode="append"):
    """Run a ``foreachBatch`` job over all that is there."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()


def review_rows(spark, sf_dir):
    return reviews(spark, sf_dir).select("event_id", "user_id", "product_id", "rating", "timestamp")


def action_rows(spark, sf_dir):
    return T.actions(spark, sf_dir).select("event_id", "user_id", "product_id", "action", "timestamp")


@register("stream_review_triggers", f"""WITH {Q.ACTIONS_CTE},
n AS (SELECT user_id, count(*) AS n FROM actions WHERE coalesce(user_id <> '', false) GROUP BY user_id)
SELECT user_id, unnest(range(10, n + 1, 10)) AS review_number FROM n""")
def q_stream_review_triggers(spark, sf_dir):
    """STR5: one trigger at every tenth event of a user, over several micro-batches
    (of the actions, of which a user has more than reviews)."""
    root = _root(spark, sf_dir, "triggers")
    out = BatchTable(spark, f"{root}/out", N.PAIR_OR_TRIGGER)
    stream = as_stream(action_rows(spark, sf_dir), f"{root}/in")
    drain(N.review_triggers(stream), lambda b, i: out.put(b, i), root)
    return out.upto(out.last_batch()).where("review_number is not null").select("user_id", "review_number")


@register("stream_user_neighbours", f"""{_REVIEWS}, {Q.sets_cte('sets', 'reviews')}, {Q.neighbours_cte('sets')}
SELECT user_id, neighbour_id, similarity, common, rank FROM sets_nb""")
def q_stream_user_neighbours(spark, sf_dir):
    """STR5: neighbours from common-product counts kept up to date review by review."""
    root = _root(spark, sf_dir, "neighbours")
    job = N.recommendation_job(spark, root, merge_every=2, buckets=8)
    stream = as_stream(review_rows(spark, sf_dir), f"{root}/in")
    drain(N.review_triggers(stream), job, root)
    return job.index.neighbours(job.rows.last_batch())


def _profiles(spark, sf_dir, key, schema):
    root = _root(spark, sf_dir, f"{key}_profiles")
    out = BatchTable(spark, f"{root}/out", schema)
    rs = as_stream(review_rows(spark, sf_dir), f"{root}/reviews")
    acts = as_stream(action_rows(spark, sf_dir), f"{root}/actions")
    drain(running_profiles(rs, acts, key), lambda b, i: out.put(b, i), root, "update")
    return EJ.latest(out, key).drop("expired")


@register("stream_user_profiles", ORACLE["user_profiles"])
def q_stream_user_profiles(spark, sf_dir):
    """STR4: running user profiles in processor state; each user's last row."""
    return _profiles(spark, sf_dir, "user_id", EJ.USER_PROFILE)


@register("stream_product_profiles", f"""WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE}, {Q.profile_cte('product_id', 'user_id', 'unique_users')}
SELECT product_id, reviews, interactions, unique_users, total_rating, avg_rating FROM prof_product_id""")
def q_stream_product_profiles(spark, sf_dir):
    """STR4: running product profiles in processor state; each product's last row."""
    return _profiles(spark, sf_dir, "product_id", EJ.PRODUCT_PROFILE)


@register("stream_report", f"""WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE}, {Q.profile_cte('user_id', 'product_id', 'products_count')},
{Q.profile_cte('product_id', 'user_id', 'unique_users')}
SELECT (SELECT count(*) FROM reviews) AS csv_reviews_processed, (SELECT count(*) FROM actions) AS interactions_processed,
  (SELECT count(*) FROM prof_user_id) AS total_users, (SELECT count(*) FROM prof_product_id) AS total_products,
  (SELECT {Q.rhu('sum(reviews) / count(*)', 2)} FROM prof_user_id) AS avg_reviews_per_user,
  (SELECT coalesce({Q.rhu('avg(CASE WHEN avg_rating > 0 THEN avg_rating END)', 2)}, 0.0::DOUBLE) FROM prof_user_id) AS avg_rating_given,
  (SELECT coalesce({Q.rhu('avg(CASE WHEN avg_rating > 0 THEN avg_rating END)', 2)}, 0.0::DOUBLE) FROM prof_product_id) AS avg_product_rating,
  true AS unique_users_within_error, true AS unique_products_within_error""")
def q_stream_report(spark, sf_dir):
    """STR6: the report from merged partial aggregates; sums and averages exact,
    the sketches' distinct counts held against the exact number of profiles (3 %)."""
    root = _root(spark, sf_dir, "report")
    job = R.report_job(spark, root, merge_every=2)
    rv, act = review_rows(spark, sf_dir), action_rows(spark, sf_dir)
    events = rv.withColumns({"action": F.lit(None).cast("string"), "kind": F.lit("review")}).unionByName(
        act.withColumns({"rating": F.lit(None).cast("string"), "kind": F.lit("interaction")}))
    drain(as_stream(events, f"{root}/in"), job, root)
    doc = job.report.document(job.report.totals.last_batch())
    s, u, p = (F.col("processing_summary"), F.col("user_analytics.totals"), F.col("product_analytics.totals"))

    def near(estimate, exact):
        return F.abs(estimate - exact) <= 0.03 * exact + 1

    return doc.select(
        s["csv_reviews_processed"].alias("csv_reviews_processed"), s["interactions_processed"].alias("interactions_processed"),
        u["total_users"].alias("total_users"), p["total_products"].alias("total_products"),
        u["avg_reviews_per_user"].alias("avg_reviews_per_user"), u["avg_rating_given"].alias("avg_rating_given"),
        p["avg_product_rating"].alias("avg_product_rating"),
        near(s["unique_users"], u["total_users"]).alias("unique_users_within_error"),
        near(s["unique_products"], p["total_products"]).alias("unique_products_within_error"))


@register("stream_file_backlog", f"""WITH {Q.ACTIONS_CTE}
SELECT i AS batch_id, CAST({FILES} - 1 - i AS BIGINT) AS files_left, true AS rows_add_up FROM range({FILES}) r(i)""")
def q_stream_file_backlog(spark, sf_dir):
    """STR9: files and rows of a file source not yet read, after each micro-batch;
    rows read and rows left must add up to the table."""
    root = _root(spark, sf_dir, "backlog")
    rows = action_rows(spark, sf_dir)
    total = rows.count()
    stream = as_stream(rows, f"{root}/in")
    schema = stream.schema.simpleString()[7:-1].replace(":", " ")
    out = BatchTable(spark, f"{root}/out", "input_rows long, files_left long, rows_left long")

    def each(batch, batch_id):
        left = L.file_backlog(spark, f"{root}/in", f"{root}/checkpoint", schema) \
            .agg(F.count(F.lit(1)).alias("files_left"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_left"))
        out.put(left.withColumn("input_rows", F.lit(batch.count())), batch_id)

    drain(stream, each, root)
    seen = out.upto(out.last_batch())
    so_far = F.sum("input_rows").over(Window.orderBy("batch_id"))  # one row per micro-batch
    return seen.select("batch_id", "files_left", (so_far + F.col("rows_left") == total).alias("rows_add_up"))


@register("stream_event_recommendations", ORACLE["event_recommendations"])
def q_stream_event_recommendations(spark, sf_dir):
    """JN6 as a stream: every event joined to the recommendations, read anew for each micro-batch."""
    from shoplens.plans.q_events import api_events
    root = _root(spark, sf_dir, "event_recommendations")
    neighbour_recs(spark, sf_dir).write.parquet(f"{root}/recommendations")
    ev = api_events(spark, sf_dir)
    ev = ev.select(F.col("event_id").cast("string").alias("event_id"), "user_id", "action")
    ev.repartition(FILES).write.parquet(f"{root}/in")
    stream = J.file_event_stream(spark, f"{root}/in", ev.schema.simpleString()[7:-1].replace(":", " "), max_files=1)
    out = BatchTable(spark, f"{root}/out", EJ.SERVED)
    drain(stream, EJ.event_recommendation_job(out, lambda: spark.read.parquet(f"{root}/recommendations")), root)
    return out.upto(out.last_batch()).drop("batch_id").withColumn("event_id", F.col("event_id").cast("long"))


@register("layered_daily_products", f"""WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE},
ev AS (SELECT CAST(timestamp AS DATE) AS date, product_id, true AS review, {Q.rating_value('rating')} AS r, NULL AS w FROM reviews
  UNION ALL SELECT CAST(timestamp AS DATE), product_id, false, NULL, {Q.weight('action')}::DOUBLE FROM actions)
SELECT date, product_id, count(*) FILTER (WHERE review) AS reviews, count(*) FILTER (WHERE NOT review) AS interactions,
  count(r) AS rated, coalesce(sum(r), 0.0::DOUBLE) AS total_rating, coalesce(sum(w), 0.0::DOUBLE) AS action_weight
FROM ev WHERE product_id IS NOT NULL AND trim(product_id) <> '' GROUP BY date, product_id""")
def q_layered_daily_products(spark, sf_dir):
    """SNK2 + SNK6: both event kinds through bronze and silver into gold, in
    batches of which one is delivered twice; gold's daily product totals read back."""
    layers = Layers(spark, _root(spark, sf_dir, "layers"))
    rv, act = review_rows(spark, sf_dir), action_rows(spark, sf_dir)
    half = F.xxhash64("event_id") % 2 == 0
    layers.process("reviews", rv, 0)
    for batch_id, rows in ((1, act.where(half)), (2, act.where(~half)), (2, act.where(~half)), (3, act.where(half))):
        layers.process("interactions", rows, batch_id)
    return layers.read("gold", "product_profiles").withColumn("date", F.col("date").cast("date")) \
        .select("date", "product_id", "reviews", "interactions", "rated", "total_rating", "action_weight")
