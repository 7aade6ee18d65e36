"""Global 1-based sequence numbers without funnelling rows through one task.

``row_number() over (order by ...)`` with no partition moves every row into a
single partition.  Here the rows are range-partitioned by a distributed sort,
each row records its partition id and its position inside the partition, and
that tagged result is checkpointed (a reliable checkpoint in the shared
``spark.checkpoint.dir``) so the numbering is fixed once: re-planning the sort
could otherwise pick other range bounds or another AQE partition coalescing for
the count than for the rows.  A tiny per-partition count table (one row per
partition, a proven bound) then gives each partition its starting offset.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.session import ensure_checkpoint_dir


def with_global_sequence(df: DataFrame, order_cols: list | None, name: str = "seq") -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_cols``.

    The order columns must form a unique key so the numbering is deterministic.
    With ``order_cols=None`` the rows keep their current partitioning and the
    result is a dense numbering in no particular order (no sort; fixed by the
    checkpoint).  Runs one job (the sort + checkpoint) when called.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # with a sort, the input is read by the range sampling and by the sort,
    # and the sorted rows by the count and by the checkpoint write: keep both
    # for the duration (memory, spilling to disk) so nothing is computed
    # twice.  Without a sort (a dense index of a cheap distinct) caching costs
    # more than it saves.
    keep = bool(order_cols)
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df
    base = src.orderBy(*order_cols) if order_cols else src
    tagged = (base
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # position inside a partition: the low 33 bits of monotonically_increasing_id
    tagged = tagged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
    if keep:
        tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
    frozen = tagged.checkpoint(eager=True)
    if keep:
        tagged.unpersist()
        src.unpersist()
    tagged = frozen
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos") + F.lit(1))
            .drop("_pid", "_pos", "_off"))


def with_running_total(df: DataFrame, order_cols: list, weight: str, name: str) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows up to this one in the order
    ``order_cols`` (a unique key): sorted ranges are summed inside each partition
    and shifted by the totals of the partitions before (one row per partition)."""
    ensure_checkpoint_dir(df.sparkSession)
    frozen = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = frozen.groupBy("_pid").agg(F.sum(weight).alias("_w")) \
        .select("_pid", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    return (frozen.withColumn(name, F.sum(weight).over(inside)).join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col(name) + F.col("_off")).drop("_pid", "_off"))
