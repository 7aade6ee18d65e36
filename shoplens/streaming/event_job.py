"""The whole event job: source -> dedupe -> enrich -> sinks, state and report.

One call starts the queries of a deployment on a stream of reviews and one of
interactions, each with its own checkpoint below ``root``:

- ``reviews``, ``interactions``: deduplicated and enriched events as JSON by date;
- ``user_profiles``, ``product_profiles``: running profiles, one table each;
- ``recommendations``: review triggers, the neighbour index, what it serves;
- ``report``: partial aggregates and the analytics documents;
- ``event_recommendations``: views answered from what has been served so far.

With ``available_now`` every query ends when it has read what is there (a
bounded run); started again on the same ``root`` it goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.operators import recommend as RC
from shoplens.sinks.writers import with_event_date
from shoplens.streaming import jobs as J
from shoplens.streaming import neighbours as N
from shoplens.streaming import report as R
from shoplens.streaming.state import running_profiles
from shoplens.streaming.tables import BatchTable

USER_PROFILE = ("user_id string, reviews long, interactions long, products_count long, total_rating double, "
                "avg_rating double, expired boolean")
PRODUCT_PROFILE = USER_PROFILE.replace("user_id", "product_id").replace("products_count", "unique_users")
SERVED = "event_id string, user_id string, action string, recommendations_generated long, top_recommendation string"


def latest(table: BatchTable, key: str, batch_id: int | None = None) -> DataFrame:
    """The last row of each key in a table of running profiles."""
    rows = table.upto(table.last_batch() if batch_id is None else batch_id)
    values = [c for c in table.schema.names if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(key, "v.*")


def served_recommendations(table: BatchTable) -> DataFrame:
    """Each user's latest recommendations (user_id, product_id, score, rank)."""
    rows = table.upto(table.last_batch())
    last = rows.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["user_id", "batch_id"]).drop("batch_id")


def event_recommendation_job(out: BatchTable, recommendations, n: int = 3):
    """JN6 as a stream: a ``foreachBatch`` function that joins each micro-batch of
    API events to the recommendations as they stand then.  ``recommendations`` is
    a function that gives the static side anew for every batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        events = batch.select("event_id", F.col("user_id").cast("string").alias("user_id"), "action")
        out.put(RC.event_recommendations(events, recommendations(), n), batch_id)

    return run


class EventJob:
    """Queries and result tables of one deployment."""

    def __init__(self, spark: SparkSession, root: str, every_reviews: int = C.REVIEWS_PER_RECOMMENDATION,
                 every_events: int = C.EVENTS_PER_REPORT, watermark: str = "10 minutes", merge_every: int = 50):
        self.spark, self.root, self.watermark = spark, root.rstrip("/"), watermark
        self.every_reviews = every_reviews
        self.user_profiles = BatchTable(spark, f"{self.root}/user_profiles", USER_PROFILE)
        self.product_profiles = BatchTable(spark, f"{self.root}/product_profiles", PRODUCT_PROFILE)
        self.served = BatchTable(spark, f"{self.root}/event_recommendations", SERVED)
        self.recommend = N.recommendation_job(spark, f"{self.root}/recommendations", merge_every)
        self.report = R.report_job(spark, f"{self.root}/report", every_events, merge_every)

    def _start(self, df: DataFrame, name: str, available_now: bool, each=None, mode: str = "append"):
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{self.root}/checkpoints/{name}")
        if each is None:
            w = with_event_date(df).writeStream.outputMode(mode).format("json").partitionBy("date") \
                .option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/checkpoints/{name}")
        else:
            w = w.foreachBatch(each)
        return (w.trigger(availableNow=True) if available_now else w).start()

    def start(self, reviews: DataFrame, interactions: DataFrame, available_now: bool = True) -> list:
        """Start all queries; returns them."""
        rv = J.dedupe_events(reviews, self.watermark)
        act = J.dedupe_events(interactions, self.watermark)
        both = ["event_id", "user_id", "product_id", "timestamp"]
        events = rv.select(*both, "rating", F.lit(None).cast("string").alias("action"), F.lit("review").alias("kind")) \
            .unionByName(act.select(*both, F.lit(None).cast("string").alias("rating"), "action",
                                    F.lit("interaction").alias("kind")))
        go = self._start
        return [
            go(J.enrich_review_stream(rv), "reviews", available_now),
            go(J.enrich_interaction_stream(act), "interactions", available_now),
            go(running_profiles(reviews, interactions, "user_id"), "user_profiles", available_now,
               lambda b, i: self.user_profiles.put(b, i), "update"),
            go(running_profiles(reviews, interactions, "product_id"), "product_profiles", available_now,
               lambda b, i: self.product_profiles.put(b, i), "update"),
            go(N.review_triggers(reviews, self.every_reviews), "recommendations", available_now, self.recommend),
            go(events, "report", available_now, self.report),
            go(interactions, "event_recommendations", available_now, event_recommendation_job(
                self.served, lambda: served_recommendations(self.recommend.recommendations))),
        ]
