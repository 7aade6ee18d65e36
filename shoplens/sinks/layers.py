"""SNK2 + SNK6: bronze, silver and gold areas maintained batch by batch.

bronze/<kind>   rows as they came, partitioned by arrival batch
silver/<kind>   cleaned events, one row per event key, partitioned by event date
gold/<area>     what is read: daily totals by product and by user (partitioned by
                date), recommendations (by user bucket), analytics documents

Each hop is an idempotent upsert by dynamic partition overwrite: the partitions
that a batch touches are read, merged with its rows by key and written again,
the others stay as they are.  A batch delivered again, in part or as a whole,
leaves every area as it was.  The merged rows are checkpointed before they
replace the partitions they were read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions import scalars as S
from shoplens.operators import events as E
from shoplens.session import ensure_checkpoint_dir

EVENT_AREAS = ("reviews", "interactions")
GOLD_AREAS = ("user_profiles", "product_profiles", "recommendations", "analytics")
RECOMMENDATION_BUCKETS = 64


class Layers:
    """The areas below ``root``: bronze and silver of both event kinds, four of gold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ensure_checkpoint_dir(spark)

    def path(self, layer: str, area: str) -> str:
        allowed = GOLD_AREAS if layer == "gold" else EVENT_AREAS
        if layer not in ("bronze", "silver", "gold") or area not in allowed:
            raise ValueError(f"no area {layer}/{area}")
        return f"{self.root}/{layer}/{area}"

    def exists(self, layer: str, area: str) -> bool:
        """Does the area hold a partition?  (A dynamic overwrite leaves no mark of success but its folders.)"""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(layer, area))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and any("=" in s.getPath().getName() for s in fs.listStatus(path))

    def read(self, layer: str, area: str) -> DataFrame:
        reader = self.spark.read
        return (reader.json if area == "analytics" else reader.parquet)(self.path(layer, area))

    def _replace(self, df: DataFrame, layer: str, area: str, by: str) -> None:
        (df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(self.path(layer, area)))

    def ingest(self, kind: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """A batch of ``reviews`` or ``interactions`` into bronze and silver; returns the dates it touched."""
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path("bronze", kind))
        bronze = self.read("bronze", kind).where(F.col("batch_id") == batch_id).drop("batch_id")
        clean = cleaned(bronze)
        dates = clean.select("date").distinct().checkpoint(eager=True)
        if self.exists("silver", kind):
            # silver first: an event already there stays as it is
            known = self.read("silver", kind).join(F.broadcast(dates), "date", "left_semi") \
                .withColumn("date", F.col("date").cast("date"))
            clean = known.select(*clean.columns).unionByName(clean.join(known.select("event_key", "date"),
                                                                        ["event_key", "date"], "left_anti"))
        self._replace(clean.checkpoint(eager=True), "silver", kind, "date")
        return dates

    def refresh_gold(self, dates: DataFrame) -> None:
        """Daily user and product totals of the dates, from silver alone."""
        parts = []
        for kind in EVENT_AREAS:
            if self.exists("silver", kind):
                ev = self.read("silver", kind).withColumn("date", F.col("date").cast("date")) \
                    .join(F.broadcast(dates), "date", "left_semi")
                parts.append(daily_inputs(ev, kind))
        if parts:
            events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            for area, key in (("user_profiles", "user_id"), ("product_profiles", "product_id")):
                self._replace(daily_totals(events, key), "gold", area, "date")

    def put_recommendations(self, recs: DataFrame) -> None:
        """Upsert per user: a user's recommendations replace the earlier ones."""
        new = recs.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(RECOMMENDATION_BUCKETS)).cast("int"))
        if self.exists("gold", "recommendations"):
            users, buckets = new.select("user_id").distinct(), new.select("bucket").distinct()
            old = self.read("gold", "recommendations").join(F.broadcast(buckets), "bucket", "left_semi") \
                .join(users, "user_id", "left_anti")
            new = new.unionByName(old.select(*new.columns))
        self._replace(new.checkpoint(eager=True), "gold", "recommendations", "bucket")

    def put_analytics(self, document: DataFrame, batch_id: int) -> None:
        document.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").json(self.path("gold", "analytics"))

    def process(self, kind: str, rows: DataFrame, batch_id: int) -> None:
        """One hop after the other for a batch."""
        self.refresh_gold(self.ingest(kind, rows, batch_id))


def cleaned(rows: DataFrame) -> DataFrame:
    """Events with a time, blank ids as null, one row per event key (an event
    without an id is known by a hash of its row)."""
    blank = {c: F.when(F.trim(c) != "", F.trim(c)) for c in ("user_id", "product_id") if c in rows.columns}
    keyed = rows.withColumn("event_key", E.event_key(rows)).withColumns(blank) \
        .withColumn("date", F.to_date("timestamp")).where(F.col("date").isNotNull())
    values = [c for c in keyed.columns if c not in ("event_key", "date")]
    # deliveries of one event on one date: the first in the order of their text
    first = keyed.groupBy("event_key", "date").agg(F.min_by(F.struct(*values), F.to_json(F.struct(*values))).alias("v"))
    return first.select("event_key", *[F.col("v")[c].alias(c) for c in values], "date")


def daily_inputs(events: DataFrame, kind: str) -> DataFrame:
    review = kind == "reviews"
    none = F.lit(None).cast("double")
    return events.select("date", "user_id", "product_id", F.lit(review).alias("is_review"),
                         (S.rating_value("rating") if review else none).alias("rating_num"),
                         (none if review else S.action_weight("action")).alias("weight"))


def daily_totals(events: DataFrame, key: str) -> DataFrame:
    """Reviews, interactions, rated sum and count, and action weight per date and key."""
    return events.where(F.col(key).isNotNull()).groupBy("date", key).agg(
        F.count_if("is_review").alias("reviews"), F.count_if(~F.col("is_review")).alias("interactions"),
        F.count("rating_num").alias("rated"), F.coalesce(F.sum("rating_num"), F.lit(0.0)).alias("total_rating"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("action_weight"))
