"""The feed's gate: what is late, repeated or follows a silence, in batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.runtime import ship_package

#: Verdicts of a tick, by code.
VERDICTS = ("accepted", "duplicate", "out_of_order", "untimed")


def verdicts(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """`rows` (symbol, ts, ...) with verdict by order of arrival: accepted, out_of_order, duplicate or, without a time, untimed.

    A tick is compared with the latest accepted before it, which is the latest of all
    before it, as what is not accepted is never later.
    """
    before = Window.partitionBy("symbol").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_seen", F.max("ts").over(before)).withColumn(
        "verdict",
        F.when(F.col("ts").isNull(), "untimed")
        .when(F.col("ts") < F.col("_seen"), "out_of_order")
        .when(F.col("ts") == F.col("_seen"), "duplicate")
        .otherwise("accepted"),
    ).drop("_seen")


def foreign(rows: DataFrame, symbols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ticks of the symbols that a feed asked for, in a table or a stream, and those that it did not, which are counted and never judged."""
    own = F.coalesce(F.col("symbol").isin(symbols), F.lit(False))
    return rows.where(own), rows.where(~own)


def silences(rows: DataFrame, seconds: float) -> DataFrame:
    """Ticks that follow a gap of more than so many seconds in their symbol."""
    ordered = Window.partitionBy("symbol").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6
    return (
        rows.select("symbol", "ts", F.lag("ts").over(ordered).alias("before"))
        .where("before IS NOT NULL")
        .withColumn("after_silence", gap > seconds)
        .where("after_silence")
    )


def staleness(rows: DataFrame, now: str, seconds: float) -> DataFrame:
    """Per symbol the last tick and whether the feed is stale at `now`."""
    last = rows.groupBy("symbol").agg(F.max("ts").alias("last_tick"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_tick").cast("timestamp"))
    return last.withColumn("stale", F.coalesce(age > seconds * 1e6, F.lit(True)))


def judged(ts: np.ndarray, seen: int | None) -> tuple[np.ndarray, int | None]:
    """Codes (0 accepted, 1 duplicate, 2 out of order, 3 untimed) of times in order of arrival, and the latest time after them.

    A tick is compared with the latest before it, `seen` included. NO_TIME has no place among the times.
    """
    codes = np.full(len(ts), 3, np.int8)
    timed = ts != NO_TIME
    own = ts[timed]
    if not len(own):
        return codes, seen
    latest = np.maximum.accumulate(np.append(NO_TIME if seen is None else seen, own))
    codes[timed] = np.where(own > latest[:-1], 0, np.where(own == latest[:-1], 1, 2))
    return codes, int(latest[-1])


#: Rows that go back to Spark at once.
CHUNK = 1 << 16
#: What an absent time becomes as a number.
NO_TIME = np.iinfo(np.int64).min


def micros(ts: pd.Series) -> np.ndarray:
    """Microseconds since the epoch, NO_TIME where there is none."""
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def in_order(rows: Iterator[pd.DataFrame], columns: list[str], arrival: str = "event_id") -> pd.DataFrame:
    """All rows of a symbol in one micro-batch, by arrival; a group comes in several chunks, whose order says nothing.

    Only `columns` are held, and they grow with the micro-batch, which its source must bound.
    """
    return pd.concat([chunk[columns] for chunk in rows], ignore_index=True).sort_values(arrival, kind="stable", ignore_index=True)


class Gate(StatefulProcessor):
    """Keeps the time of each symbol's latest accepted tick; rows of one batch are taken in order of event_id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, ["ts", "event_id", "price", "volume"])
        codes, seen = judged(micros(batch.ts), self.latest.get()[0] if self.latest.exists() else None)
        if seen is not None:
            self.latest.update((seen,))
        for start in range(0, len(batch), CHUNK):
            part = batch.iloc[start : start + CHUNK]
            yield pd.DataFrame(
                {"symbol": key[0], **{c: part[c] for c in ("ts", "event_id", "price", "volume")}, "verdict": np.array(VERDICTS, object)[codes[start : start + CHUNK]]}
            )

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame) -> DataFrame:
    """A stream of ticks (symbol, ts timestamp, event_id, price, volume) with verdicts by a state per symbol.

    A symbol's rows of one micro-batch are held together, as their order of arrival
    decides; sources bound a micro-batch (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    ship_package()
    return stream.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Gate(),
        outputStructType="symbol string, ts timestamp, event_id long, price double, volume double, verdict string",
        outputMode="append",
        timeMode="None",
    )
