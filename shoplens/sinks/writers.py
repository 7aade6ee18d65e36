"""Writers (SNK1, SNK3, SNK5; the layers of SNK2 and SNK6 are in ``sinks.layers``).

Paths are parameters; on a cluster they name shared storage.  The format is a
parameter too; asking for one whose connector is missing is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators.sequence import with_global_sequence


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """SNK1 (gold dimension) and generic table writes."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def with_event_date(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.to_date(ts_col))


def json_stream_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """SNK3: processed records as JSON lines partitioned by date -- many rows
    per file instead of one object per file."""
    w = (with_event_date(df).writeStream.format("json").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def write_csv_sample(df: DataFrame, path: str) -> None:
    """SNK5: CSV with a header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_documents(df: DataFrame, path: str, rows_per_document: int = 100_000) -> None:
    """Write rows as JSON array documents (the SRC2 input format).  Rows are
    dealt by their number, so that no document holds more than
    ``rows_per_document`` however often a row repeats."""
    cols = df.columns
    numbered = with_global_sequence(df, None, "_seq")
    docs = (numbered.withColumn("doc", F.expr(f"(_seq - 1) div {rows_per_document}"))
            .groupBy("doc").agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value")))
    # one folder per document: a multiLine JSON file holds exactly one value
    docs.write.mode("overwrite").partitionBy("doc").text(path)
