"""STR4: running user and product profiles in processor state.

One processor serves both keys.  Counters and the inputs of the stale average
(AGG3) lie in a value state, the partners (a user's products, a product's users)
in a map state with an entry each, so that no profile becomes one large value.
Rows are taken chunk by chunk with vectorised sums; the state is asked once per
distinct partner of a chunk, not per row.

With a life (``ttl``) a profile lasts that long after its last event: a timer,
moved on with each event, emits the profile a last time (``expired``) and clears
it.  Every map entry carries the life as its time to live; the value state has
twice that, so that its last values are there when the timer fires.  A
partner not seen for that long no longer counts.  Timers fire in batches without
data, so a query with a life runs until it is stopped: give it a processing-time
trigger, not ``availableNow``, which would never end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shoplens.functions import scalars as S

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "reviews long, interactions long, partners long, total_rating double, avg_rating double"


def use_rocksdb(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB state store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


class ProfileProcessor(StatefulProcessor):
    """Profile of one key; ``key_col`` and ``partners_col`` name the output columns."""

    def __init__(self, key_col: str, partners_col: str, ttl_ms: int | None = None):
        self.key_col, self.partners_col, self.ttl_ms = key_col, partners_col, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS, 2 * self.ttl_ms if self.ttl_ms else None)
        self.partners = handle.getMapState("partners", "partner string", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        reviews, interactions, partners, total, avg = self.counts.get() or (0, 0, 0, 0.0, 0.0)
        for chunk in rows:
            is_review = (chunk["kind"].to_numpy(dtype=object) == "review")
            interactions += int(len(chunk) - is_review.sum())
            if not is_review.any():
                continue  # order, ratings and partners are the reviews' alone
            chunk = chunk[is_review]
            chunk = chunk.sort_values(["timestamp", "event_id"], kind="stable")
            rating = chunk["rating_num"].to_numpy(dtype=float, na_value=np.nan)
            rated = ~np.isnan(rating)
            if rated.any():  # the average is renewed at a rated review and divides by all reviews so far
                last = np.flatnonzero(rated)[-1]
                total += float(rating[rated].sum())
                avg = total / (reviews + int(last) + 1)
            reviews += len(chunk)
            for p in chunk["partner"].dropna().unique():
                if p and (self.ttl_ms or not self.partners.containsKey((p,))):
                    self.partners.updateValue((p,), (True,))  # with a life: seen again, lives on
                    partners += 1
        if self.ttl_ms:
            partners = sum(1 for _ in self.partners.keys())
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        self.counts.update((reviews, interactions, partners, total, avg))
        yield self._row(key, (reviews, interactions, partners, total, avg), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0.0, 0.0)
        self.counts.clear()
        self.partners.clear()
        yield self._row(key, last, True)

    def _row(self, key, counts, expired: bool) -> pd.DataFrame:
        names = ("reviews", "interactions", self.partners_col, "total_rating", "avg_rating")
        return pd.DataFrame({self.key_col: [key[0]], **{n: [v] for n, v in zip(names, counts)}, "expired": [expired]})

    def close(self) -> None:
        pass


def running_profiles(reviews: DataFrame, interactions: DataFrame, key: str = "user_id", ttl_ms: int | None = None) -> DataFrame:
    """Profiles by ``user_id`` (with ``products_count``) or ``product_id`` (with
    ``unique_users``): one row per key and micro-batch (update mode) as it stands
    after the batch, ``expired`` where its life ended.  Rows are applied in batch
    order, inside a micro-batch in the order of the chunks, each sorted by time
    and id; counters and sums do not depend on it, the stale average follows it.
    All rows of a key are one task's work in a batch: a batch's size bounds it."""
    other, partners = {"user_id": ("product_id", "products_count"), "product_id": ("user_id", "unique_users")}[key]
    use_rocksdb(reviews.sparkSession)
    rev = reviews.select(key, F.col(other).alias("partner"), "event_id", "timestamp",
                         S.rating_value("rating").alias("rating_num"), F.lit("review").alias("kind"))
    act = interactions.select(key, F.col(other).alias("partner"), "event_id", "timestamp",
                              F.lit(None).cast("double").alias("rating_num"), F.lit("interaction").alias("kind"))
    events = rev.unionByName(act).where(F.coalesce(F.col(key) != "", F.lit(False)))
    out = (f"{key} string, reviews long, interactions long, {partners} long, total_rating double, avg_rating double, "
           "expired boolean")
    return events.groupBy(key).transformWithStateInPandas(
        ProfileProcessor(key, partners, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")
