"""Feeds that fall silent: event-time timers tell it without a further tick of the feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.runtime import ship_package
from tidebook.streaming.gate import in_order, judged, micros

OUTPUT = "symbol string, event string, last_tick timestamp, moment timestamp"


class Silence(StatefulProcessor):
    """Per symbol the moment that its silence is counted from and whether it has been told.

    That moment is the latest accepted tick, or for a feed that never ticked when it was
    asked for. A timer stands where the silence becomes longer than allowed.
    """

    def __init__(self, allowed: int):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "mark long, ticked boolean, told boolean")

    def _expiry(self, mark: int) -> int:
        """The first whole millisecond after the allowed silence; timers know no finer time."""
        return (mark + self.allowed) // 1000 + 1

    def _wait(self, mark: int, ticked: bool) -> None:
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        self.held.update((mark, ticked, False))
        self.handle.registerTimer(self._expiry(mark))

    def _rows(self, symbol: str, event: str, last: np.ndarray, moment: np.ndarray) -> pd.DataFrame:
        at = lambda v: pd.to_datetime(pd.Series(v), unit="us")
        return pd.DataFrame({"symbol": symbol, "event": event, "last_tick": at(last), "moment": at(moment)})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._wait(int(micros(initialState.since).max()), False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts = micros(in_order(rows, ["ts", "event_id"]).ts)
        mark, ticked, told = self.held.get() if self.held.exists() else (None, False, False)
        codes, _ = judged(ts, mark if ticked else None)
        good = ts[codes == 0]
        if not len(good):
            return
        before = np.concatenate([[good[0] if mark is None else mark], good[:-1]])
        gap = good - before > self.allowed
        gap[0] |= told
        last = pd.Series(before[gap], dtype="Int64")
        untold = gap.copy()
        untold[0] &= not told
        if gap[0] and not ticked:
            last.iloc[0] = pd.NA  # asked for, and nothing came
        opened = last[untold[gap]]
        self._wait(int(good[-1]), True)
        yield self._rows(key[0], "silent", opened, before[untold] + self.allowed)
        yield self._rows(key[0], "resumed", last, good[gap])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, ticked, _ = self.held.get()
        self.held.update((mark, ticked, True))
        yield self._rows(key[0], "silent", pd.Series([mark if ticked else None], dtype="Int64"), np.array([mark + self.allowed]))

    def close(self) -> None:
        pass


def silence_stream(ticks: DataFrame, seconds: float, delay: str, asked: DataFrame | None = None) -> DataFrame:
    """Events of feeds in a stream of ticks (symbol, ts timestamp, event_id): `silent` and `resumed`.

    A feed is silent from the moment at which its latest accepted tick is more than
    `seconds` old. The clock is the watermark: the latest tick of any feed less `delay`.
    It tells of a silence that still lasts; one that a later tick of the same micro-batch
    ends is told with that tick. So each silence gives one row `silent`, its moment
    the end of what is allowed, and, once over, one row `resumed` with the tick that
    ended it, however the ticks are cut in batches. Only ticks that the gate accepts
    count; ticks without a time do not, nor do those that come behind the watermark of
    earlier batches, which Spark drops.

    `asked` (symbol, since timestamp): feeds that were asked for. One that never ticks is
    silent too, from `seconds` after that on, without a last tick.
    """
    if seconds <= 0:
        raise ValueError("the allowed silence must be positive")
    ship_package()
    timed = ticks.where("ts IS NOT NULL").select("symbol", "ts", "event_id").withWatermark("ts", delay)
    return timed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Silence(round(seconds * 1e6)), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime",
        initialState=None if asked is None else asked.groupBy("symbol").agg(F.max("since").alias("since")).groupBy("symbol"),
    )
