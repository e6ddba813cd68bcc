"""Keyed state with timers: jobs that go quiet, and counts of a rolling day.

Both run on ``transformWithStateInPandas`` over the RocksDB state store. State and timers live in the stream's
checkpoint, so a restart goes on with them; a row replayed after a failure is folded in again by its order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lectern.operators.planning import DAILY_CAP

# The age at which a heartbeat is stale, and the rolling day.
HEARTBEAT_SECONDS = 90
DAY_HOURS = 24

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Start a stream inside: it takes the state store that timers need, other streams keep theirs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class HeartbeatWatch(StatefulProcessor):
    """Newest state of one job, and a timer that calls a running job interrupted once it is quiet."""

    def __init__(self, seconds: int, job: str):
        self.quiet_ms, self.job = seconds * 1000, job

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "beat long, seq long, status string, step long, timer long")

    def _show(self, key, beat: int, seq: int, status: str, step: int) -> pd.DataFrame:
        return pd.DataFrame({self.job: [key[0]], "beat_us": [beat], "seq": [seq], "status": [status], "step": [step]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for some in rows:
            some = some.sort_values(["beat_us", "seq"])
            last = (int(some["beat_us"].iloc[-1]), int(some["seq"].iloc[-1]), some["status"].iloc[-1])
            newest = last if newest is None else max(newest, last, key=lambda r: r[:2])
        step, timer = 0, -1
        if self.state.exists():
            beat, seq, _, step, timer = self.state.get()
            if newest is None or newest[:2] <= (beat, seq):
                return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        beat, seq, status = newest
        timer = beat // 1000 + self.quiet_ms if status == "running" else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.state.update((beat, seq, status, step + 1, timer))
        yield self._show(key, beat, seq, status, step + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        beat, seq, status, step, timer = self.state.get()
        if status == "running" and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((beat, seq, "interrupted", step + 1, -1))
            yield self._show(key, beat, seq, "interrupted", step + 1)


def job_changes(
    beats: DataFrame,
    job: str = "job_id",
    at: str = "heartbeat_at",
    status: str = "status",
    seq: str = "seq",
    seconds: int = HEARTBEAT_SECONDS,
    clock: str = "wall",
    late: str = "0 seconds",
) -> DataFrame:
    """Every change of a job's status: its newest row's, and ``interrupted`` when a running job goes quiet.

    ``clock`` is ``wall`` (timers run on the machines' time, and fire without any new row) or ``event``
    (they run on the log's own time, ``late`` behind the newest heartbeat). A job interrupted runs again at its next
    heartbeat. Rows come with ``step``, their place among the job's changes. Rows without a job or time are left out.
    """
    moment = F.col(at).cast("timestamp")
    rows = beats.where(F.col(job).isNotNull() & F.col(at).isNotNull()).select(
        F.col(job),
        moment.alias("beat_time"),
        F.unix_micros(moment).alias("beat_us"),
        F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("seq"),
        F.coalesce(F.col(status), F.lit("")).alias("status"),
    )
    if clock == "event":
        rows = rows.withWatermark("beat_time", late)
    elif clock != "wall":
        raise ValueError("clock is wall or event")
    longs = [StructField(c, LongType()) for c in ("beat_us", "seq")]
    shape = StructType([beats.schema[job], *longs, StructField("status", StringType()), StructField("step", LongType())])
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    changes = rows.groupBy(job).transformWithStateInPandas(HeartbeatWatch(seconds, job), shape, "update", mode)
    kind = beats.schema[at].dataType
    return changes.select(job, "status", F.timestamp_micros("beat_us").cast(kind).alias(at), "seq", "step")


class RollingDay(StatefulProcessor):
    """Creations of one user by the hour, for a day; an hour's counts are told when no row can join it.

    A user has one timer: at the end of the first hour not told, or else when the last hour is to be dropped.
    """

    def __init__(self, user: str, cap: int):
        self.user, self.cap = user, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "ts array<long>, key array<long>")
        self.told = handle.getValueState("told", "hour long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, before: int | None, at: int) -> None:
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, keys = (np.concatenate(c) for c in zip(*((some["ts_us"].to_numpy(), some["key"].to_numpy()) for some in rows)))
        order = np.argsort(ts // HOUR_US, kind="stable")
        ts, keys = ts[order], keys[order]
        hours, starts = np.unique(ts // HOUR_US, return_index=True)
        timer = self.timer.get()
        # A user without a timer has no state.
        held = {h[0]: v for h, v in self.hours.iterator()} if timer else {}
        for hour, of in zip(hours.tolist(), zip(np.split(ts, starts[1:]), np.split(keys, starts[1:]))):
            old = held.get(hour, ((), ()))
            self.hours.updateValue((hour,), tuple([*was, *more.tolist()] for was, more in zip(old, of)))
        told = self.told.get()
        untold = hours[hours > told[0]] if told else hours
        at = (int(untold[0]) + 1) * HOUR_US // 1000 if len(untold) else None
        if at is not None and (not timer or at < timer[0]):
            self._wake(timer[0] if timer else None, at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer tells every hour that is over.
        told = self.told.get()
        last = told[0] if told else -(1 << 60)
        over = timerValues.getCurrentWatermarkInMs() * 1000 // HOUR_US  # the first hour that is not
        held = {h[0]: v for h, v in self.hours.iterator()}
        due = sorted(h for h in held if last < h < over)
        for h in [h for h in held if h < over - DAY_HOURS]:
            self.hours.removeKey((h,))
        left = [h for h in held if h >= over - DAY_HOURS]
        if left:
            self.told.update((over - 1,))
            # A day after its last use an hour is dropped, whether or not the user comes back.
            coming = [h + 1 for h in left if h >= over] or [max(left) + DAY_HOURS + 2]
            self._wake(None, min(coming) * HOUR_US // 1000)
        else:
            self.told.clear()
            self.timer.clear()
        if not due:
            return
        past = np.sort(np.concatenate([np.array(held[h][0], np.int64) for h in sorted(held) if h < over]))
        ts = np.concatenate([np.array(held[h][0], np.int64) for h in due])
        keys = np.concatenate([np.array(held[h][1], np.int64) for h in due])
        count = np.searchsorted(past, ts, "right") - np.searchsorted(past, ts - DAY_HOURS * HOUR_US, "left")
        yield pd.DataFrame({self.user: key[0], "ts_us": ts, "key": keys, "in_day": count, "over_cap": count - 1 >= self.cap})


def rolling_day_stream(stream: DataFrame, user: str, ts: str, key: str, cap: int = DAILY_CAP, late: str = "1 hour") -> DataFrame:
    """Each creation with its user's creations in the 24 hours up to it, once no earlier row can come.

    The log may be out of order by ``late``. A user's state is the last day of creations, an hour a
    state row; it is empty a day after the last one. ``key`` is a whole number. Rows
    without a user or time are left out.
    """
    moment = F.col(ts).cast("timestamp")
    rows = stream.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(user), moment.alias("event_time"), F.unix_micros(moment).alias("ts_us"), F.col(key).cast("long").alias("key")
    )
    longs = [StructField(c, LongType()) for c in ("ts_us", "key", "in_day")]
    shape = StructType([stream.schema[user], *longs, StructField("over_cap", BooleanType())])
    counted = rows.withWatermark("event_time", late).groupBy(user).transformWithStateInPandas(RollingDay(user, cap), shape, "append", "EventTime")
    return counted.select(
        user,
        F.timestamp_micros("ts_us").cast(stream.schema[ts].dataType).alias(ts),
        F.col("key").cast(stream.schema[key].dataType).alias(key),
        "in_day",
        "over_cap",
    )
