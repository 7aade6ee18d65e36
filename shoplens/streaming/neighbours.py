"""STR5: neighbour recommendations kept up to date while reviews stream in.

``ReviewProcessor`` holds the number of reviews per user, which gives a trigger row
at every n-th review whatever the sizes of the batches: one reading and one
writing of its state per user and batch.  Which (user, product) pairs were not seen
before is Spark's own deduplication, keyed by the pair, so that a user with very
many products is not one task's work.  ``NeighbourIndex`` turns those new pairs into increments of the
users' common-product counts: a new pair (u, p) adds one to (u, v) for every
holder v of p.  A batch reads the holders of its own products, and for the users
to be served their own pair counts, set sizes and neighbours' sets; nothing is
computed again from the start.

The increments of a product with m holders are m a new holder: that is what
common-product counts consist of.  The join on the product is split by adaptive
execution where one product is hot, and increments are summed before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shoplens import constants as C
from shoplens.operators import recommend as RC
from shoplens.streaming.state import use_rocksdb
from shoplens.streaming.tables import BatchTable

PAIR_OR_TRIGGER = "user_id string, product_id string, review_number long, event_id string"


class ReviewProcessor(StatefulProcessor):
    """Per user: one row for every ``every``-th review."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reviews = handle.getValueState("reviews", "n long")

    def handleInputRows(self, key, rows, timerValues):
        (user,) = key
        n = (self.reviews.get() or (0,))[0]
        for chunk in rows:
            due = list(range((n // self.every + 1) * self.every, n + len(chunk) + 1, self.every))
            if due:
                order = _arrival(chunk)
                events = chunk["event_id"].to_numpy(dtype=object)[order[[m - n - 1 for m in due]]]
                yield pd.DataFrame({"user_id": [user] * len(due), "product_id": [None] * len(due),
                                    "review_number": pd.array(due, dtype="Int64"), "event_id": events})
            n += len(chunk)
        self.reviews.update((n,))

    def close(self) -> None:
        pass


def _arrival(chunk: pd.DataFrame) -> np.ndarray:
    """Places of the rows by time and id, nulls last."""
    if chunk["timestamp"].hasnans or chunk["event_id"].hasnans:
        return np.asarray(chunk.reset_index(drop=True).sort_values(["timestamp", "event_id"], kind="stable").index)
    return np.lexsort((chunk["event_id"].to_numpy(dtype=object), chunk["timestamp"].to_numpy()))


def review_triggers(reviews: DataFrame, every: int = C.REVIEWS_PER_RECOMMENDATION) -> DataFrame:
    """New (user, product) pairs and a trigger row at each user's every ``every``-th
    review.  Reviews without a user are left out.  The event named by a trigger is
    the n-th in arrival order (inside a micro-batch: by time and id within each
    chunk Spark hands over); how many triggers a user gets does not depend on it."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    use_rocksdb(reviews.sparkSession)
    known = reviews.where(F.coalesce(F.col("user_id") != "", F.lit(False)))
    pairs = known.where(F.coalesce(F.col("product_id") != "", F.lit(False))).select("user_id", "product_id").dropDuplicates()
    triggers = known.select("user_id", "event_id", "timestamp").groupBy("user_id").transformWithStateInPandas(
        ReviewProcessor(every), PAIR_OR_TRIGGER, "Append", "None")
    return triggers.unionByName(pairs, allowMissingColumns=True)


class NeighbourIndex:
    """User sets, holders of products and common-product counts, kept per batch below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, merge_every: int = 50):
        pair = "user_id string, product_id string"
        self.spark, self.merge_every = spark, merge_every
        self.by_user = BatchTable(spark, f"{root}/by_user", pair, "user_id", buckets)
        self.by_product = BatchTable(spark, f"{root}/by_product", pair, "product_id", buckets)
        self.sizes = BatchTable(spark, f"{root}/sizes", "user_id string, n long", "user_id", buckets)
        self.pairs = BatchTable(spark, f"{root}/pairs", "user_id string, other_id string, common long", "user_id", buckets)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Take in the (user_id, product_id) rows of a batch; pairs known from earlier batches change nothing."""
        seen = RC.interaction_sets(rows)
        known = self.by_user.before(batch_id, self.by_user.buckets_of(seen, "user_id")).select("user_id", "product_id")
        new = self.by_user.put(seen.join(known, ["user_id", "product_id"], "left_anti"), batch_id) \
            .select("user_id", "product_id")
        self.by_product.put(new, batch_id)
        self.sizes.put(new.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), batch_id)
        holders = self.by_product.before(batch_id, self.by_product.buckets_of(new, "product_id")) \
            .select("product_id", F.col("user_id").alias("other_id"))
        met = new.join(holders, "product_id").select("user_id", "other_id")
        among = new.join(new.withColumnRenamed("user_id", "other_id"), "product_id") \
            .where(F.col("user_id") != F.col("other_id")).select("user_id", "other_id")
        increments = met.unionByName(met.select(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"))) \
            .unionByName(among).groupBy("user_id", "other_id").agg(F.count(F.lit(1)).alias("common"))
        self.pairs.put(increments, batch_id)
        if (batch_id + 1) % self.merge_every == 0:
            self.merge(batch_id)

    def merge(self, batch_id: int) -> None:
        """Sum the batches so far into one generation of each table."""
        for table in (self.by_user, self.by_product):
            table.merge(table.upto(batch_id).select("user_id", "product_id"), batch_id)
        self.sizes.merge(self._sizes(batch_id), batch_id)
        self.pairs.merge(self._pairs(self.pairs.upto(batch_id)), batch_id)

    def _sizes(self, batch_id: int) -> DataFrame:
        return self.sizes.upto(batch_id).groupBy("user_id").agg(F.sum("n").alias("n"))

    @staticmethod
    def _pairs(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id", "other_id").agg(F.sum("common").alias("common"))

    def neighbours(self, batch_id: int, users: DataFrame | None = None, k: int = C.TOP_NEIGHBOURS,
                   threshold: float = C.JACCARD_THRESHOLD) -> DataFrame:
        """(user_id, neighbour_id, similarity, common, rank) of the users (all, if none are given)."""
        if users is None:
            rows = self.pairs.upto(batch_id)
        else:
            rows = self.pairs.upto(batch_id, self.pairs.buckets_of(users, "user_id")).join(users, "user_id", "left_semi")
        sizes = self._sizes(batch_id)
        other = sizes.select(F.col("user_id").alias("other_id"), F.col("n").alias("n_other"))
        j = self._pairs(rows).join(sizes, "user_id").join(other, "other_id")
        j = j.withColumn("similarity", F.col("common") / (F.col("n") + F.col("n_other") - F.col("common"))) \
            .where(F.col("similarity") > threshold)
        w = Window.partitionBy("user_id").orderBy(F.desc("similarity"), F.asc("other_id"))
        return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .select("user_id", F.col("other_id").alias("neighbour_id"), "similarity", "common", "rank")

    def recommend(self, batch_id: int, users: DataFrame, k: int = C.TOP_RECOMMENDATIONS) -> DataFrame:
        """REC3 for the users, from the sets as they are after ``batch_id``."""
        users = users.select("user_id").distinct()
        near = self.neighbours(batch_id, users)
        needed = near.select("user_id").unionByName(near.select(F.col("neighbour_id").alias("user_id")))
        sets = self.by_user.upto(batch_id, self.by_user.buckets_of(needed, "user_id")).select("user_id", "product_id")
        return RC.neighbour_recommendations(sets, near, k)


def recommendation_job(spark: SparkSession, root: str, merge_every: int = 50, buckets: int = 64):
    """A ``foreachBatch`` function for ``review_triggers``: the batch's new pairs go
    into the index, the users it triggered get their recommendations.  Below
    ``root``: ``rows`` (the batch as it came), ``index``, ``recommendations``
    (user_id, product_id, score, rank by batch)."""
    index = NeighbourIndex(spark, f"{root}/index", buckets, merge_every)
    came = BatchTable(spark, f"{root}/rows", PAIR_OR_TRIGGER)
    served = BatchTable(spark, f"{root}/recommendations", "user_id string, product_id string, score double, rank int")

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = came.put(batch, batch_id)  # the stateful operator runs once
        index.add(rows.where("product_id is not null"), batch_id)
        served.put(index.recommend(batch_id, rows.where("review_number is not null")), batch_id)

    run.index, run.rows, run.recommendations = index, came, served
    return run
