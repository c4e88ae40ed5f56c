"""Streams: exactly-once ingest, windowed counts, and a stateful tracker with timers. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_once(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each key once, with state bounded by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def split_stamps(rows: DataFrame, at: str, now, ahead: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(usable, unusable): stamps that are absent or too far ahead go aside before the watermark, so they neither move it nor get lost."""
    good = F.col(at).isNotNull() & (F.col(at) <= F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {ahead}"))
    return rows.where(good), rows.where(~F.coalesce(good, F.lit(False)))


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, delay: str = "1 day") -> DataFrame:
    """Counts in tumbling windows; state is dropped behind the watermark."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


class AppearanceTracker(StatefulProcessor):
    """State of a key: the members of each open snapshot, and those of the last one that was closed.

    A snapshot is a stretch of ``width_ms`` of event time. It is closed by a timer at its end, when the
    watermark has got there; rows of one snapshot may come in any number of batches until then. A key
    that has had no snapshot for ``keep`` stretches is forgotten. Members are kept as the JSON text of
    their sorted list, as arrays would go through the state's channel element by element.
    """

    def __init__(self, member: str, keys: list[str], width_ms: int, keep: int):
        self.member, self.keys, self.width_ms, self.keep = member, keys, width_ms, keep

    def init(self, handle) -> None:
        members = T.StructField("members", T.StringType())
        snapshot = T.StructField("snapshot", T.LongType())
        self.handle = handle
        self.open = handle.getMapState("open", T.StructType([snapshot]), T.StructType([members]))
        self.last = handle.getValueState("last", T.StructType([snapshot, members]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, set] = {}
        for batch in rows:
            for s, m in zip(batch["snapshot_"].tolist(), batch[self.member].tolist()):
                new.setdefault(s, set()).add(m)
        for s, members in new.items():
            if self.open.containsKey((s,)):
                members |= set(json.loads(self.open.getValue((s,))[0]))
            else:
                self.handle.registerTimer((s + 1) * self.width_ms)
            self.open.updateValue((s,), (json.dumps(sorted(members)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = expiredTimerInfo.getExpiryTimeInMs() // self.width_ms - 1
        before = self.last.get() if self.last.exists() else None
        if not self.open.containsKey((s,)):  # the time to forget a key that had no later snapshot
            if before is not None and before[0] + self.keep <= s:
                self.last.clear()
            return
        text = self.open.getValue((s,))[0]
        now, old = json.loads(text), set(json.loads(before[1])) if before is not None else set()
        lost = sorted(old.difference(now))
        states = ["persistent" if m in old else "gained" for m in now] + ["lost"] * len(lost)
        self.open.removeKey((s,))
        self.last.update((s, text))
        self.handle.registerTimer((s + self.keep + 1) * self.width_ms)
        columns = {self.member: now + lost, "snapshot": s, "state": states}
        yield pd.DataFrame({k: [v] * len(states) for k, v in zip(self.keys, key)} | columns)[[*self.keys, self.member, "snapshot", "state"]]

    def close(self) -> None:
        pass


def track_appearances(stream: DataFrame, keys: list[str], member: str, at: str, width_ms: int, delay: str, keep: int = 400) -> DataFrame:
    """(keys, member, snapshot, state): which members each snapshot of a key gained, kept (persistent) and lost.

    A snapshot is the stretch floor(``at`` / ``width_ms``) of event time, in which a key has a row or
    more; it is compared with the key's snapshot before it, whatever lies between, and the first one
    gains all. Rows repeat without effect. Results come when the watermark (``delay`` behind the
    newest row) passes the end of a snapshot, so they do not depend on batches or their order; rows
    behind the watermark are dropped, and counted by :func:`late_rows`. Rows without a stamp or a
    member go. State is what one or a few snapshots of a key hold; a key without a snapshot for
    ``keep`` stretches is forgotten, after which its next one gains all.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    named = stream.where(F.col(at).isNotNull() & F.col(member).isNotNull()).withWatermark(at, delay)
    rows = named.select(*keys, F.col(member).cast("string").alias(member), at, F.expr(f"unix_millis({at}) div {width_ms}").alias("snapshot_"))
    columns = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(AppearanceTracker(member, keys, width_ms, keep), f"{columns}, {member} string, snapshot long, state string", "append", "eventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows all batches of a query have dropped behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is into a table of files, exactly once, and read it."""
    q = df.writeStream.format("parquet").option("path", path).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
