"""New-file stream, JSON stream sink, topic routing and the foreachBatch jobs."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from shoplens.operators import events as E
from shoplens.sinks import writers as W
from shoplens.sources import files as FS
from shoplens.sources import tables as T
from shoplens.streaming import jobs as J
from tests.conftest import SF_SMALL

ACTION_SCHEMA = ("event_id string, user_id string, product_id string, action string, "
                 "timestamp timestamp_ntz, source string, original_rating double, confidence double")


def test_new_file_stream_reads_each_csv_once(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-csvstream-")
    for i in range(3):
        with open(os.path.join(folder, f"part{i}.csv"), "w") as f:
            f.write("asin,title\n" + "".join(f"A{i}{j},t{j}\n" for j in range(4)))
    with open(os.path.join(folder, "ignored.txt"), "w") as f:
        f.write("asin,title\nX,Y\n")
    out = tempfile.mkdtemp(prefix="shoplens-csvout-")
    ckpt = tempfile.mkdtemp(prefix="shoplens-ckpt-")

    def run():
        q = (FS.new_file_stream(spark, folder, ["asin", "title"], max_files=1).writeStream
             .format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        return spark.read.parquet(out).count()

    assert run() == 12
    # a restart with the same checkpoint sends no file again
    assert run() == 12


def test_json_stream_sink_partitions_by_date(spark):
    acts = T.actions(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="shoplens-src-")
    acts.repartition(2).write.mode("overwrite").parquet(src)
    out = tempfile.mkdtemp(prefix="shoplens-out-")
    ckpt = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    stream = J.enrich_interaction_stream(J.file_event_stream(spark, src, ACTION_SCHEMA, max_files=1))
    W.json_stream_sink(stream, out, ckpt).awaitTermination(120)
    days = glob.glob(os.path.join(out, "date=*"))
    assert len(days) == acts.select(F.to_date("timestamp")).distinct().count()
    back = spark.read.json(out)
    assert back.count() == acts.count()


def test_route_by_topic(spark):
    recs = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("zzz", 4)], "topic string, v int")
    assert [r.v for r in E.route_by_topic(recs, "a").orderBy("v").collect()] == [1, 3]
    assert E.route_by_topic(recs, "unknown").count() == 0
