"""STR9: lag and throughput of streaming queries.

``MetricsWriter`` is a listener that appends one JSON line per micro-batch to a
folder (each in a file of its own, so that a reader never meets half a line):
rows and rates, rows dropped by the watermark, the source's start, end and latest
offsets as Spark reports them, the lag they mean where the source names its
latest offsets, and the counts gathered with ``observe()``.  ``read_metrics``
gives them as a table.  ``file_backlog`` measures the lag of a file source,
which reports no latest offset: the files of its folder that no batch has read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from shoplens.sources.files import plain_path

METRICS = ("query_id string, run_id string, query_name string, batch_id long, timestamp string, source string, "
           "input_rows long, input_rows_per_second double, processed_rows_per_second double, "
           "rows_dropped_by_watermark long, start_offset string, end_offset string, latest_offset string, "
           "lag long, observed map<string,string>")


def offset_total(text: str | None) -> int | None:
    """All positions of an offset document added up: a plain number, or numbers
    nested under topic and partition; null if it holds none."""
    if not text:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None

    def total(v) -> int | None:
        if isinstance(v, bool):
            return None
        if isinstance(v, int):
            return v
        parts = [total(x) for x in v.values()] if isinstance(v, dict) else []
        parts = [p for p in parts if p is not None]
        return sum(parts) if parts else None

    return total(value)


def offset_lag(end: str | None, latest: str | None) -> int | None:
    """Records between a source's end and latest offsets, null if either is unknown."""
    a, b = offset_total(end), offset_total(latest)
    return None if a is None or b is None else max(0, b - a)


class MetricsWriter(StreamingQueryListener):
    """Appends the progress of every micro-batch below ``path``; keeps nothing in the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        dropped = sum(getattr(s, "numRowsDroppedByWatermark", 0) or 0 for s in p.stateOperators)
        observed = {f"{name}.{k}": str(v) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        lines = []
        for s in p.sources:
            lines.append({"query_id": str(p.id), "run_id": str(p.runId), "query_name": p.name, "batch_id": p.batchId,
                          "timestamp": p.timestamp, "source": s.description, "input_rows": s.numInputRows,
                          "input_rows_per_second": _number(s.inputRowsPerSecond),
                          "processed_rows_per_second": _number(s.processedRowsPerSecond),
                          "rows_dropped_by_watermark": int(dropped), "start_offset": _text(s.startOffset),
                          "end_offset": _text(s.endOffset), "latest_offset": _text(s.latestOffset),
                          "lag": offset_lag(_text(s.endOffset), _text(s.latestOffset)), "observed": observed})
        if lines:
            self._append("".join(json.dumps(x) + "\n" for x in lines))

    def _append(self, text: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{uuid.uuid4().hex}.json")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        hidden = jvm.org.apache.hadoop.fs.Path(path.getParent(), "_" + path.getName())
        out = fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(hidden, path)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def _number(v) -> float:
    return float(v) if v is not None and v == v and abs(v) != float("inf") else 0.0


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def observed_counts(stream: DataFrame, name: str = "events") -> DataFrame:
    """The stream with its rows and rows without an event id counted per micro-batch."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_id").isNull()).alias("without_id"))


def file_backlog(spark: SparkSession, folder: str, checkpoint: str, schema: str, fmt: str = "parquet",
                 source: int = 0) -> DataFrame:
    """(path, rows) of the files below ``folder`` that the query with this
    checkpoint has not read yet, from its source log.  Files of a batch that is
    planned but not finished count as read.  Paths are compared percent-encoded,
    as both the log and Spark's file column hold them."""
    log = spark.read.text(f"{checkpoint.rstrip('/')}/sources/{source}") if _exists(spark, f"{checkpoint}/sources/{source}") \
        else spark.createDataFrame([], "value string")
    done = log.select(plain_path(F.get_json_object("value", "$.path")).alias("path")).where("path is not null").distinct()
    rows = spark.read.format(fmt).schema(schema).load(folder).select(plain_path(F.col("_metadata.file_path")).alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).join(done, "path", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
