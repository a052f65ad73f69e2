"""Keyed state that expires by event time: a cache with a lifetime, and runs that went silent."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAYS = 25  # fixed value: lifetime of a cached upload
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store that state with timers needs


def _millis(times: pd.Series) -> pd.Series:
    return times.dt.tz_localize(None).astype("datetime64[us]").astype("int64") // 1000


def _micros(times: pd.Series) -> np.ndarray:
    return times.dt.tz_localize(None).to_numpy().astype("datetime64[us]").astype(np.int64)


class _Cache(StatefulProcessor):
    """First sight of a key is a miss and is remembered; sights within the lifetime are hits and give the stored value. Once the watermark has
    passed the end of the lifetime, a timer frees the key."""

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._slot = handle, handle.getValueState("slot", "value long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = held = self._slot.get()
        frames = list(rows)  # the sights of one key in one micro-batch
        seen = frames[0] if len(frames) == 1 else pd.concat(frames)
        ats, values = _micros(seen["ts"]), seen["value"].to_numpy()
        order = np.lexsort((values, np.where(ats < -(1 << 62), 1 << 62, ats)))  # no time: last
        stored, hits = [], []
        for at, value in zip((ats[order] // 1000).tolist(), values[order].tolist()):
            hit = held is not None and at - held[1] < self.lifetime
            if not hit:
                held = (int(value), at)
            stored.append(held[0])
            hits.append(hit)
        if held != before:
            if before is not None:
                self._handle.deleteTimer(before[1] + self.lifetime)
            self._slot.update(held)
            self._handle.registerTimer(held[1] + self.lifetime)
        yield pd.DataFrame({"key": key[0], "ts": seen["ts"].array.take(order), "value": stored, "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._slot.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[us, UTC]"), "value": pd.Series(dtype="int64"), "hit": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def cached(events: DataFrame, late: str = "1 hour", days: float = DAYS) -> DataFrame:
    """Every sight of a key with the cached value and whether it was a hit. ``events``: key string, ts timestamp, value long. A key's state lives
    until the watermark, ``late`` behind the newest event, is a lifetime past the event that stored it."""
    return events.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Cache(int(days * 86_400_000)), outputStructType="key string, ts timestamp, value long, hit boolean", outputMode="Update", timeMode="EventTime")


class _Silence(StatefulProcessor):
    """Reports a run with each batch of its events, and once more, as stale, if nothing came for ``age`` after the newest. A run that ended is forgotten."""

    def __init__(self, age: int):
        self.age = age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._newest = handle, handle.getValueState("newest", "at long")

    def _report(self, key, at: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, pd.Timestamp(at, unit="ms", tz="UTC"), stale)], columns=["run_id", "updated_at", "stale"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._newest.get()[0] if self._newest.exists() else None
        newest, ended = held, False
        for b in rows:  # only the newest is kept, so a batch of any size streams
            at = _millis(b["ts"])
            k = at.idxmax()
            if newest is None or at[k] >= newest:
                last = at == at[k]
                newest, ended = int(at[k]), bool(b.loc[last, "ended"].any()) or (ended and at[k] == newest)
        if held is not None and (newest != held or ended):
            self._handle.deleteTimer(held + self.age)
        if ended:
            self._newest.clear()
        elif newest != held:
            self._newest.update((newest,))
            self._handle.registerTimer(newest + self.age)
        yield self._report(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self._newest.get()[0]
        self._newest.clear()
        yield self._report(key, at, True)

    def close(self) -> None:
        pass


def silent(events: DataFrame, age: float, late: str = "1 hour") -> DataFrame:
    """(run_id, updated_at, stale): runs whose newest event lies more than ``age`` seconds behind the watermark become stale by a timer, without a
    new event of their own; a later event makes them fresh again. ``events``: run_id long, ts timestamp, ended boolean (its newest event ended it)."""
    return events.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Silence(int(age * 1000)), outputStructType="run_id long, updated_at timestamp, stale boolean", outputMode="Update", timeMode="EventTime")
