"""Topic sources and sinks (SRC8-SRC10, SNK4).

They need the Kafka connector on the classpath (absent in this build
environment); the functions build the standard reader/writer so a cluster with
the connector runs them unchanged.  Tests use file streams instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: topic names ---------------------------------------------------
REVIEW_TOPIC = "amazon-csv-reviews"
INTERACTION_TOPIC = "user-interactions"
PRODUCT_TOPIC = "amazon-products"
USER_TOPIC = "user-topic"


def topic_stream(spark: SparkSession, servers: str, topics: list[str],
                 starting: str = "latest", max_offsets: int | None = None) -> DataFrame:
    """SRC8/SRC9/SRC10: topic records with key and value as text plus
    topic, partition and offset."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", ",".join(topics)).option("startingOffsets", starting))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    return r.load().select(F.col("key").cast("string").alias("key"),
                           F.col("value").cast("string").alias("value"),
                           "topic", "partition", "offset", "timestamp")


def decode(records: DataFrame, schema: str) -> DataFrame:
    """SCL12: parse the JSON value with a declared schema."""
    return records.select("topic", "partition", "offset", F.from_json("value", schema).alias("e")) \
                  .select("topic", "partition", "offset", "e.*")


def publish(records: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """SNK4: write (key, value) records to a topic, batch or stream."""
    if records.isStreaming:
        return (records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("topic", topic).option("checkpointLocation", checkpoint).start())
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    return None
