"""Rate limits and lockouts: trailing counts, admission where rejected requests do not count, failures in a row."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heliograph.operators.folds import Stepwise, ordered_fold


def trailing_counts(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """df with ``in_window``: rows of the key in the ``seconds`` up to and with each row."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def _admit(times, held: deque, limit: int, seconds: float) -> list[bool]:
    """Which requests pass; held has the times of those that passed, and is changed."""
    out = []
    for t in times:
        while held and t - held[0] >= seconds:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


class _Window(Stepwise):
    """The times of what passed, at most ``limit``."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros, self.held = limit, micros, deque()

    def step(self, at: int | None) -> tuple:
        return (True if at is None else _admit([at], self.held, self.limit, self.micros)[0],)


def admitted(df: DataFrame, key: str, order: list[str], at: str, limit: int, seconds: float) -> DataFrame:
    """df with ``allowed``. What passes depends on what passed before, so a key's rows are one ordered fold.

    The state is at most ``limit`` times. A null key is a key; a row without a time passes and does not count.
    """
    return ordered_fold(df, [key], order, [F.unix_micros(F.col(at).cast("timestamp"))], lambda: _Window(limit, int(seconds * 1e6)), "allowed boolean")


def _unit(s: pd.Series) -> float:
    return {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(s.dt, "unit", "ns")]


def admitted_stream(df: DataFrame, key: str, ident: str, at: str, limit: int, seconds: float) -> DataFrame:
    """(key, ident, allowed) of a stream; the state of a key expires when the watermark passes its window."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        frame = pd.concat(list(frames)).sort_values([at, ident])
        times = frame[at].astype("int64").to_numpy() / _unit(frame[at])
        allowed = _admit(times, held, limit, seconds)
        state.update(([float(t) for t in held],))
        state.setTimeoutTimestamp(max(int((held[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], ident: frame[ident], "allowed": allowed})

    out = f"{key} {kinds[key]}, {ident} {kinds[ident]}, allowed boolean"
    timed = df.select(key, ident, at).withWatermark(at, f"{int(seconds)} seconds")
    return timed.groupBy(key).applyInPandasWithState(step, out, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class Lock(Stepwise):
    """A key's failures in a row, and until when it is locked; times and ``length`` are in one unit."""

    def __init__(self, most: int, length: int, count: int = 0, until: int = 0):
        self.most, self.length, self.count, self.until = most, length, count, until

    def step(self, at: int | None, failed: bool | None) -> tuple:
        if at is None or failed is None:
            return (False,)
        if at < self.until:
            return (True,)
        self.count = self.count + 1 if failed else 0
        if self.count >= self.most:
            self.count, self.until = 0, at + self.length
        return (False,)


def lockouts(df: DataFrame, key: str, order: list[str], at: str, failed: str, most: int, seconds: float) -> DataFrame:
    """df with ``locked``: attempts while a key is locked, which is for ``seconds`` after ``most`` failures in a row.

    Attempts of a locked key change nothing; a success, and the lock's end, start the count anew. A null key is a key;
    an attempt without a time or an outcome is not locked and changes nothing.
    """
    values = [F.unix_micros(F.col(at).cast("timestamp")), F.col(failed).cast("boolean")]
    return ordered_fold(df, [key], order, values, lambda: Lock(most, int(seconds * 1e6)), "locked boolean")


class _LockProcessor(StatefulProcessor):
    """Attempts wait until the watermark passes them, run through the lock in order, and leave; a lock that ended leaves no state."""

    def __init__(self, most: int, seconds: float):
        self.most, self.length = most, int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ident string, failed boolean")
        self.lock = handle.getValueState("lock", "count int, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first: int | None = None
        for frame in rows:
            new = [(int(t), str(i), bool(f)) for t, i, f in zip(frame["micros"], frame["ident"], frame["failed"])]
            self.waiting.appendList(new)
            first = min([t for t, _, _ in new] + ([] if first is None else [first]), default=None)
        if first is not None:  # one timer a batch: when it fires, the next attempt that waits gets one
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(a), i, bool(f)) for a, i, f in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        count, until = self.lock.get() if self.lock.exists() else (0, 0)
        lock = Lock(self.most, self.length, int(count), int(until))
        locked = [lock.step(a, f)[0] for a, _, f in due]
        if due:
            rest = rows[len(due) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            else:
                self.waiting.clear()
        if lock.count or lock.until > passed:
            self.lock.update((lock.count, lock.until))
            if due and lock.until > passed:
                self.handle.registerTimer(-(-lock.until // 1000))
        elif self.lock.exists():
            self.lock.clear()
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "ident": [i for _, i, _ in due], "locked": locked})

    def close(self) -> None:
        pass


def lockouts_stream(df: DataFrame, key: str, ident: str, at: str, failed: str, most: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """(key, ident, locked) of a stream, as ``lockouts`` ordered by time and id gives it; key and id as text.

    Attempts may come in any order within ``late``: they are judged when the watermark has passed them, and locks end
    by timers, so a key keeps state only while it has failures in a row, a lock, or attempts to judge. Needs the RocksDB
    state store. A null key is a key; attempts without a time or an outcome are left out.
    """
    whole = df.where(F.col(at).isNotNull() & F.col(failed).isNotNull())
    rows = whole.select(F.to_json(F.struct(F.col(key).alias("k"))).alias("key"), F.col(ident).cast("string").alias("ident"), F.col(at).alias("at"), F.col(failed).cast("boolean").alias("failed"))
    timed = rows.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    found = timed.groupBy("key").transformWithStateInPandas(_LockProcessor(most, seconds), "key string, ident string, locked boolean", "append", "eventTime")
    return found.select(F.get_json_object("key", "$.k").alias(key), F.col("ident").alias(ident), "locked")
