"""Streams that keep small state per key and send results when event time has passed.

Each processor holds what is still open and sets a timer for the moment at which it can no longer change; what a timer
closes is appended to the output once and forgotten. They need a state store that supports them, see `timed`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import micros
from ..schema import q
from ..session import scratch_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000


def _due(us: int) -> int:
    """A timer in milliseconds that fires when the watermark has reached the microsecond `us`."""
    return -(-us // 1000)


class OpenSessions(StatefulProcessor):
    """Sessions of a key that end after a pause; only those that may still grow are kept."""

    def __init__(self, ts: str, gap: int, key: T.StructField):
        self.ts, self.gap, self.key = ts, gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<long>, last array<long>, rows array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.open.get())) if self.open.exists() else []

    def _keep(self, sessions: list[tuple[int, int, int]]) -> None:
        """One timer, for the session that ends first: every call to the state store has its price."""
        if sessions:
            self.open.update(tuple([int(v) for v in c] for c in zip(*sessions)))
            self.handle.registerTimer(_due(min(last for _, last, _ in sessions) + self.gap))
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        known = bool(held)
        for batch in rows:
            held += [(t, t, 1) for t in micros(batch[self.ts])]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(held):
            if merged and first - merged[-1][1] <= self.gap:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, last), m + n)
            else:
                merged.append((first, last, n))
        if known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed ends now, not only what this timer was set for.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = self._held()
        done = [s for s in held if _due(s[1] + self.gap) <= now]
        self._keep([s for s in held if _due(s[1] + self.gap) > now])
        if done:
            first, last, n = zip(*done)
            yield pd.DataFrame({self.key.name: [key[0]] * len(done), "first": first, "last": last, "updates": n})

    def close(self) -> None:
        pass


class MinuteRing(StatefulProcessor):
    """Rows of a key by minute, for as many minutes as a window is long and the watermark is behind.

    A window is judged once, when its end has passed; a minute is forgotten with the last window it is part of.
    """

    def __init__(self, ts: str, minutes: int, more_than: int, key: T.StructField):
        self.ts, self.minutes, self.more_than, self.key = ts, minutes, more_than, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "minute array<long>, rows array<long>, judged long")

    def _held(self) -> tuple[dict[int, int], int | None]:
        if not self.ring.exists():
            return {}, None
        minute, rows, judged = self.ring.get()
        return dict(zip(minute, rows)), judged

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, judged = self._held()
        for batch in rows:
            for t in micros(batch[self.ts]):
                held[t // MINUTE] = held.get(t // MINUTE, 0) + 1
        self._save(held, judged)
        yield from ()

    def _save(self, held: dict[int, int], judged: int | None) -> None:
        """`judged` is the first minute whose window is open; the next timer is the end of the first window with rows."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not held:
            self.ring.clear()
            return
        if judged is None:
            judged = min(held) - self.minutes + 1
        begin = max(judged, min(held) - self.minutes + 1)
        self.ring.update(([int(m) for m in sorted(held)], [int(held[m]) for m in sorted(held)], int(begin)))
        self.handle.registerTimer(_due((begin + self.minutes) * MINUTE))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // MINUTE - self.minutes  # the last minute whose window has ended
        held, judged = self._held()
        if not held:
            return
        out = []
        for begin in sorted({m - k for m in held for k in range(self.minutes)}):
            if judged <= begin <= passed:
                n = sum(held.get(begin + k, 0) for k in range(self.minutes))
                if n > self.more_than:
                    out.append((key[0], begin * MINUTE, n))
        judged = max(judged, passed + 1)
        self._save({m: n for m, n in held.items() if m >= judged}, judged)
        if out:
            keys, starts, counts = zip(*out)
            yield pd.DataFrame({self.key.name: keys, "start": starts, "failures": counts})

    def close(self) -> None:
        pass


def timed(spark: SparkSession) -> None:
    """Choose the state store that keeps timers, for the queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)




def timed_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 3600, watermark: str = "1 hour") -> DataFrame:
    """Sessions in append output: `(key, created_at, last_update, updates)`, each once, when its pause has passed."""
    field = events.schema[key]
    grouped = events.select(q(key), q(ts)).withWatermark(ts, watermark).groupBy(q(key))
    schema = T.StructType([field, *[T.StructField(c, T.LongType()) for c in ("first", "last", "updates")]])
    found = grouped.transformWithStateInPandas(OpenSessions(ts, gap_seconds * 1_000_000, field), schema, "Append", "EventTime")
    return found.select(q(key), F.timestamp_micros("first").alias("created_at"), F.timestamp_micros("last").alias("last_update"), "updates")


def timed_brute_force(events: DataFrame, key: str, ts: str, more_than: int = 10, minutes: int = 15, watermark: str = "1 hour") -> DataFrame:
    """Windows that begin every minute and hold more rows of a key than allowed, in append output: `(key, start, failures)`."""
    field = events.schema[key]
    grouped = events.select(q(key), q(ts)).withWatermark(ts, watermark).groupBy(q(key))
    schema = T.StructType([field, *[T.StructField(c, T.LongType()) for c in ("start", "failures")]])
    found = grouped.transformWithStateInPandas(MinuteRing(ts, minutes, more_than, field), schema, "Append", "EventTime")
    return found.select(q(key), F.timestamp_micros("start").alias("start"), "failures")
