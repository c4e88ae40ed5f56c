"""The replay of the events (T13 to T15): stretches written by several tasks, one batch for each."""

import glob
import os

from pyspark.sql import functions as F

from quaystone.plans.catalog import Source
from quaystone.plans.q_pages import _event_stream
from quaystone.plans.storage import new_path
from quaystone.streaming import streams


def test_stretches_of_many_files(spark):
    s = Source(spark, "/root/testdata/sf0.001")
    n = s.events.count()
    for rows_per_file, least in ((n // 20, 2), (n * 2, 1)):
        stream = _event_stream(s, rows_per_file)
        path = max(glob.glob(new_path(spark, "event-stream").removeprefix("file:").rsplit("-", 1)[0] + "-*"), key=os.path.getmtime)
        files = sorted(glob.glob(path + "/*.parquet"), key=os.path.getmtime)
        each = len(files) // 4
        assert len(files) == 4 * each and each >= least
        bounds = [spark.read.parquet(*files[i * each : (i + 1) * each]).agg(F.min("ts"), F.max("ts"), F.count("*")).first() for i in range(4)]
        assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and sum(b[2] for b in bounds) == n
        assert all(spark.read.parquet(f).count() for f in files)
        counts = streams.windowed_counts(stream, "ts", ["event_type"], "1 day", "2 days")
        q = counts.writeStream.format("memory").queryName(f"batches_{each}").outputMode("append").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        assert len(read) == 4 and sum(read) == n and streams.late_rows(q) == 0
