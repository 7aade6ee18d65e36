"""Tables that a ``foreachBatch`` job maintains batch by batch.

Each micro-batch owns one folder, written in overwrite mode, so that a batch
delivered again after a failure replaces its own rows and nothing else.  A batch
reads the folders of the batches before it.  From time to time the rows so far
are merged into one generation (``upto=<batch>``), after which the older folders
are no longer read; a generation counts once its writer has finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def finished_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the folders ``<prefix>=n`` below ``path`` whose write has ended."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        folder = status.getPath()
        name = folder.getName()
        if name.startswith(f"{prefix}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


class BatchTable:
    """A table below ``path``; ``bucket_by`` spreads each batch over ``buckets``
    folders by a hash of that column, so that a reader that names its keys reads
    only their buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: str | None = None, buckets: int = 64):
        self.spark, self.path, self.bucket_by, self.buckets = spark, path.rstrip("/"), bucket_by, buckets
        self.schema = StructType.fromDDL(schema + (", bucket int" if bucket_by else ""))

    def bucket(self, column) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """The distinct buckets of the keys: at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self.bucket(F.col(column))).distinct().collect()]

    def _put(self, df: DataFrame, folder: str) -> None:
        if self.bucket_by:
            df = df.withColumn("bucket", self.bucket(F.col(self.bucket_by)))
            df = df.select(*self.schema.names).repartition(F.col("bucket"))
            df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        else:
            df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def put(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write the batch's rows; returns them as read back."""
        self._put(df, f"batch_id={batch_id}")
        return self._read([f"batch_id={batch_id}"])

    def merge(self, df: DataFrame, batch_id: int) -> None:
        """Write ``df`` as the merged rows of all batches up to ``batch_id``."""
        self._put(df, f"upto={batch_id}")

    def _read(self, folders: list[str]) -> DataFrame:
        """Rows of the folders with the column ``batch_id``."""
        out = None
        for prefix in ("upto", "batch_id"):
            paths = [f"{self.path}/{f}" for f in folders if f.startswith(prefix + "=")]
            if paths:
                part = self.spark.read.schema(self._with(prefix)) \
                    .option("basePath", self.path).parquet(*paths).withColumnRenamed(prefix, "batch_id")
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self._with("batch_id"))

    def _with(self, name: str) -> StructType:
        return StructType(list(self.schema.fields)).add(name, "long")

    def upto(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all batches up to ``batch_id``, of the named buckets only if given."""
        merged = [g for g in finished_folders(self.spark, self.path, "upto") if g <= batch_id]
        start = merged[-1] if merged else -1
        folders = [f"upto={start}"] if merged else []
        folders += [f"batch_id={b}" for b in finished_folders(self.spark, self.path, "batch_id") if start < b <= batch_id]
        rows = self._read(folders)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def before(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        return self.upto(batch_id - 1, buckets)

    def last_batch(self) -> int:
        """The latest batch written, -1 if none."""
        return max(finished_folders(self.spark, self.path, "batch_id"), default=-1)
