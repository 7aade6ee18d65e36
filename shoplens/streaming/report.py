"""STR6: the analytics report from mergeable partial aggregates.

Each micro-batch adds three small tables: one row of totals, one row per user
and one per product it touched.  Counts and sums merge by adding; distinct users
and products by HLL sketches (``hll_sketch_agg``, merged by ``hll_union_agg``).
The stale average (AGG3) merges too: a partial keeps the number of its reviews
up to its last rated one, and the last batch with a rated review decides.  So a
report reads the batch's own rows and the partials, never earlier events, and
``merge_every`` batches are folded into one partial per key.

Counts, sums and averages are exact.  Distinct counts are estimates with a
relative standard error of 1.04 / sqrt(2**lg_k): 0.8 % at the default of 14.
Small sets are counted exactly by the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions.scalars import rating_value
from shoplens.operators.reports import report_document
from shoplens.streaming.tables import BatchTable

LG_K = 14          # of the totals' sketches
ENTITY_LG_K = 10   # of a user's products or a product's users: 3 %, at most about 1 KB

TOTALS = "reviews long, interactions long, rated long, total_rating double, users binary, products binary"
ENTITY = "key string, reviews long, interactions long, total_rating double, rated_at long, partners binary"


def batch_events(reviews: DataFrame, interactions: DataFrame) -> DataFrame:
    """Reviews and interactions as one table; blank ids as null."""
    def present(c):
        return F.when(F.col(c) != "", F.col(c)).alias(c)

    rev = reviews.select(present("user_id"), present("product_id"), rating_value("rating").alias("rating_num"),
                         F.struct(F.col("timestamp").cast("timestamp").alias("ts"), F.col("event_id").alias("id")).alias("arrival"),
                         F.lit(True).alias("is_review"))
    act = interactions.select(present("user_id"), present("product_id"), F.lit(None).cast("double").alias("rating_num"),
                              F.lit(None).cast(rev.schema["arrival"].dataType).alias("arrival"),
                              F.lit(False).alias("is_review"))
    return rev.unionByName(act)


def totals_partial(events: DataFrame, lg_k: int = LG_K) -> DataFrame:
    return events.agg(
        F.count_if("is_review").alias("reviews"), F.count_if(~F.col("is_review")).alias("interactions"),
        F.count("rating_num").alias("rated"), F.coalesce(F.sum("rating_num"), F.lit(0.0)).alias("total_rating"),
        F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("users"), F.hll_sketch_agg("product_id", F.lit(lg_k)).alias("products"))


def entity_partial(events: DataFrame, key: str, lg_k: int = ENTITY_LG_K) -> DataFrame:
    """One row per key; ``rated_at`` = its reviews of this batch up to the last rated one (null if none is rated)."""
    other = "product_id" if key == "user_id" else "user_id"
    ev = events.where(F.col(key).isNotNull()).withColumnRenamed(key, "key")
    base = ev.groupBy("key").agg(
        F.count_if("is_review").alias("reviews"), F.count_if(~F.col("is_review")).alias("interactions"),
        F.coalesce(F.sum("rating_num"), F.lit(0.0)).alias("total_rating"),
        F.max(F.when(F.col("rating_num").isNotNull(), F.col("arrival"))).alias("last_rated"),
        F.hll_sketch_agg(F.when(F.col("is_review"), F.col(other)), F.lit(lg_k)).alias("partners"))
    # only unrated reviews can follow the last rated one: those alone meet the join
    after = (ev.where(F.col("is_review") & F.col("rating_num").isNull()).select("key", "arrival")
             .join(base.select("key", "last_rated"), "key").where(F.col("arrival") > F.col("last_rated"))
             .groupBy("key").agg(F.count(F.lit(1)).alias("after")))
    return base.join(after, "key", "left").withColumn("rated_at", F.when(
        F.col("last_rated").isNotNull(), F.col("reviews") - F.coalesce("after", F.lit(0))))


def merged_totals(partials: DataFrame) -> DataFrame:
    return partials.agg(*[F.sum(c).alias(c) for c in ("reviews", "interactions", "rated", "total_rating")],
                        F.hll_union_agg("users").alias("users"), F.hll_union_agg("products").alias("products"))


def merged_entities(partials: DataFrame) -> DataFrame:
    """One row per key; a key has a row per batch since the last merge at most, so its list is short."""
    steps = F.array_sort(F.collect_list(F.struct("batch_id", "reviews", "rated_at")))
    merged = partials.groupBy("key").agg(
        F.sum("reviews").alias("reviews"), F.sum("interactions").alias("interactions"),
        F.sum("total_rating").alias("total_rating"), F.hll_union_agg("partners").alias("partners"), steps.alias("steps"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("rated_at"))
    folded = F.aggregate("steps", start, lambda acc, s: F.struct(
        (acc["seen"] + s["reviews"]).alias("seen"),
        F.coalesce(acc["seen"] + s["rated_at"], acc["rated_at"]).alias("rated_at")))
    return merged.withColumn("rated_at", folded["rated_at"]).drop("steps")


class IncrementalReport:
    """Partials below ``root``/totals, ``root``/users and ``root``/products."""

    def __init__(self, spark: SparkSession, root: str, merge_every: int = 50):
        self.merge_every = merge_every
        self.totals = BatchTable(spark, f"{root}/totals", TOTALS)
        self.users = BatchTable(spark, f"{root}/users", ENTITY)
        self.products = BatchTable(spark, f"{root}/products", ENTITY)

    def add(self, reviews: DataFrame, interactions: DataFrame, batch_id: int) -> None:
        events = batch_events(reviews, interactions)
        self.totals.put(totals_partial(events), batch_id)
        self.users.put(entity_partial(events, "user_id"), batch_id)
        self.products.put(entity_partial(events, "product_id"), batch_id)
        if (batch_id + 1) % self.merge_every == 0:
            self.totals.merge(merged_totals(self.totals.upto(batch_id)), batch_id)
            for table in (self.users, self.products):
                table.merge(merged_entities(table.upto(batch_id)), batch_id)

    def summary(self, batch_id: int) -> DataFrame:
        """AGG7 after ``batch_id``; distinct users and products by sketch."""
        t = merged_totals(self.totals.upto(batch_id))
        n = F.coalesce("reviews", F.lit(0)), F.coalesce("interactions", F.lit(0))
        return t.select(n[0].alias("csv_reviews_processed"), n[1].alias("interactions_processed"),
                        (n[0] + n[1]).alias("files_stored"),
                        F.coalesce(F.hll_sketch_estimate("users"), F.lit(0)).alias("unique_users"),
                        F.coalesce(F.hll_sketch_estimate("products"), F.lit(0)).alias("unique_products"))

    def profiles(self, batch_id: int, key: str) -> DataFrame:
        """AGG1 / AGG2 after ``batch_id``; the distinct partners by sketch."""
        table, partners = (self.users, "products_count") if key == "user_id" else (self.products, "unique_users")
        m = merged_entities(table.upto(batch_id))
        return m.select(F.col("key").alias(key), "reviews", "interactions",
                        F.hll_sketch_estimate("partners").alias(partners), "total_rating",
                        F.coalesce(F.try_divide("total_rating", "rated_at"), F.lit(0.0)).alias("avg_rating"))

    def document(self, batch_id: int, recommendations: DataFrame | None = None) -> DataFrame:
        """RPT1 after ``batch_id`` from the partials alone."""
        return report_document(self.summary(batch_id), self.profiles(batch_id, "user_id"),
                               self.profiles(batch_id, "product_id"), recommendations)

    def events(self, batch_id: int) -> int:
        """Events up to ``batch_id`` (a sum over one row per batch)."""
        t = self.totals.upto(batch_id).agg(F.sum(F.col("reviews") + F.col("interactions"))).first()[0]
        return t or 0


def report_job(spark: SparkSession, root: str, every: int = C.EVENTS_PER_REPORT, merge_every: int = 50):
    """A ``foreachBatch`` function over a stream of reviews and interactions
    (``kind`` is ``review`` or ``interaction``).  A report is written for each
    batch in which the number of events passes a multiple of ``every``; the last
    report after a bounded run is ``run.report.document(run.report.totals.last_batch())``."""
    report = IncrementalReport(spark, f"{root}/partials", merge_every)

    def run(batch: DataFrame, batch_id: int) -> None:
        report.add(batch.where("kind = 'review'"), batch.where("kind = 'interaction'"), batch_id)
        if report.events(batch_id) // every > report.events(batch_id - 1) // every:
            report.document(batch_id).write.mode("overwrite").json(f"{root}/reports/batch_id={batch_id}")

    run.report = report
    return run
