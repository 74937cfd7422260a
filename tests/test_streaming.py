"""Streams give what their batch twins give."""

import datetime as dt

from pyspark.sql import functions as F

from heliograph.streaming import rate, tail

SCHEMA = "id long, user string, at timestamp, kind string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _rows(n=40):
    start = dt.datetime(2024, 1, 1)
    return [(i, f"u{i % 3}", start + dt.timedelta(seconds=(i * i * 7) % 600), "error" if i % 4 == 0 else "ok") for i in range(n)]


def _plain(rows, limit, seconds):
    held, out = {}, {}
    for i, u, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held[u] = [t for t in held.get(u, []) if (at - t).total_seconds() < seconds]
        out[i] = len(mine) < limit
        if out[i]:
            mine.append(at)
    return out


def test_rejected_requests_do_not_count(spark):
    rows = _rows()
    got = rate.admitted(spark.createDataFrame(rows, SCHEMA), "user", ["at", "id"], "at", 2, 60)
    assert {r["id"]: r["allowed"] for r in got.collect()} == _plain(rows, 2, 60)


def test_rate_limit_stream(spark, tmp_path):
    rows = _rows()
    _write(spark, f"{tmp_path}/log", rows)
    stream = tail.read_log(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    found = []
    rate.admitted_stream(stream, "user", "id", "at", 2, 60).writeStream.foreachBatch(lambda b, _: found.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: r["allowed"] for r in found} == _plain(rows, 2, 60)


def test_locks_set_few_timers():
    class Handle:
        def __init__(self):
            self.timers = []
            self.registerTimer = self.timers.append

        def getListState(self, *a):
            return State([])

        def getValueState(self, *a):
            return State(None)

    class State:
        def __init__(self, v):
            self.v = v

        def exists(self):
            return bool(self.v)

        def get(self):
            return self.v

        def put(self, v):
            self.v = v

        update = put

        def clear(self):
            self.v = None

        def appendList(self, v):
            self.v = [*(self.v or []), *v]

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    import pandas as pd

    handle, judged = Handle(), []
    made = rate._LockProcessor(2, 1)
    made.init(handle)
    times = [5_000_000 + 100_500 * i for i in range(50)]
    for some in (times[25:], times[:25]):
        list(made.handleInputRows(("k",), iter([pd.DataFrame({"micros": some, "ident": [str(t) for t in some], "failed": [t % 3 > 0 for t in some]})]), None))
    assert len(handle.timers) == 2
    for now in range(0, 12_000, 700):
        due = [t for t in handle.timers if t <= now]
        for t in due:
            handle.timers.remove(t)
            judged += [r for frame in made.handleExpiredTimer(("k",), Clock(now), None) for r in zip(frame["ident"], frame["locked"])]
    lock = rate.Lock(2, 1_000_000)
    assert judged == [(str(t), lock.step(t, t % 3 > 0)[0]) for t in times]


def test_forwarding_is_incremental_and_drops_repeats(spark, tmp_path):
    rows = _rows()
    _write(spark, f"{tmp_path}/log", rows[:20] + rows[:5])
    schema = spark.read.parquet(f"{tmp_path}/log").schema
    for more in (None, rows[18:]):
        if more:
            _write(spark, f"{tmp_path}/log", more)
        tail.forward(tail.read_log(spark, f"{tmp_path}/log", schema), f"{tmp_path}/out", f"{tmp_path}/cp", "id", "at").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_tail_and_backfill(spark, tmp_path):
    _write(spark, f"{tmp_path}/log", _rows(9))
    schema = spark.read.parquet(f"{tmp_path}/log").schema
    seen = []
    tail.tail(tail.read_log(spark, f"{tmp_path}/log", schema), f"{tmp_path}/cp1", lambda b, _: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 9
    for _ in range(2):
        tail.backfill(tail.read_log(spark, f"{tmp_path}/log", schema), lambda b: b.withColumn("year", F.year("at")), f"{tmp_path}/derived", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/derived").where("year = 2024").count() == 9


def test_retry_states(spark):
    rows = [("a", True), ("a", False), ("b", True), ("b", True), ("b", True), ("c", True)]
    got = tail.retry_state(spark.createDataFrame(rows, "k string, bad boolean"), "k", F.col("bad"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "done"), ("b", 3, "dead"), ("c", 1, "pending")]
