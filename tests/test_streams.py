"""The tracker with timers: batches, late rows, restarts and forgetting, against a plain loop over snapshots."""

import datetime as dt
import random

import pytest

from quaystone.plans.storage import new_path
from quaystone.streaming import streams

DAY = 86_400_000
SCHEMA = "site long, url string, at timestamp, note string"


def day(d, hour=1):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=hour)


def expected(rows, last):
    seen = {}
    for site, url, at, _ in rows:
        if url is not None and at is not None:
            seen.setdefault(site, {}).setdefault((at - dt.datetime(1970, 1, 1)).days, set()).add(url)
    out = set()
    for site, days in seen.items():
        before = set()
        for d in sorted(days):
            if dt.datetime(1970, 1, 1) + dt.timedelta(days=d + 1) <= last:
                out |= {(site, u, d, "persistent" if u in before else "gained") for u in days[d]} | {(site, u, d, "lost") for u in before - days[d]}
                before = days[d]
    return out


def run(spark, source, out, state, keep=400):
    stream = streams.track_appearances(streams.replay(spark, source, SCHEMA), ["site"], "url", "at", DAY, "2 days", keep)
    q = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.site, r.url, r.snapshot, r.state) for r in spark.read.parquet(out).collect()}, streams.late_rows(q)


@pytest.fixture
def folders(spark):
    return [new_path(spark, n) for n in ("tracker-in", "tracker-out", "tracker-state")]


def test_tracker_over_restarts_and_late_rows(spark, folders):
    source, out, state = folders
    rnd = random.Random(4)
    rows = [(s, f"u{u}", day(d, rnd.randrange(24)), "n") for s in (1, 2, 3) for d in range(12) if (s, d) not in ((2, 4), (2, 5)) for u in rnd.sample(range(8), 4)]
    rows += rows[:20] + [(1, None, day(2), "n"), (1, "u1", None, "n")]
    parts = [[r for r in rows if r[2] is None or (r[2] - day(0, 0)).days // 4 == i] for i in range(3)]
    for part in parts[:2]:
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    first, late = run(spark, source, out, state)
    newest = max(r[2] for r in parts[0] + parts[1] if r[2])
    assert first == expected(rows, newest - dt.timedelta(days=2)) and late == 0
    # Started anew from its checkpoint, with rows that come too late to count.
    too_late = [(1, "ghost", day(0), "late"), (3, "ghost", day(1), "late")]
    spark.createDataFrame(parts[2] + too_late, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    both, late = run(spark, source, out, state)
    assert both == expected(rows, max(r[2] for r in rows if r[2]) - dt.timedelta(days=2))
    assert late == 2 and not any(u == "ghost" for _, u, _, _ in both)


def test_tracker_forgets(spark, folders):
    source, out, state = folders
    rows = [(1, "a", day(0), ""), (2, "b", day(0), ""), (2, "b", day(9), ""), (1, "a", day(20), ""), (2, "b", day(20), ""), (2, "c", day(30), "")]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).write.mode("append").parquet(source)
    got, _ = run(spark, source, out, state, keep=10)
    start = (day(0) - dt.datetime(1970, 1, 1)).days
    assert got == {(1, "a", start, "gained"), (2, "b", start, "gained"), (2, "b", start + 9, "persistent"), (1, "a", start + 20, "gained"), (2, "b", start + 20, "gained")}


def test_tracker_without_rows(spark, folders):
    source, out, state = folders
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    got, late = run(spark, source, out, state)
    assert got == set() and late == 0
