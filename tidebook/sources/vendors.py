"""Bar sources behind a network: windows, candles and retries. Transports are injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook import schema
from tidebook.functions.market import period_end

# Days that one request may span, by interval.
WINDOW_DAYS = {"1m": 30, "5m": 30, "15m": 90, "1h": 90, "4h": 90, "1d": 180, "1w": 180}


class TransientError(RuntimeError):
    """Worth another try: rate limits, server errors, no connection."""


class BarSource(Protocol):
    name: str
    intervals: frozenset[str]

    def fetch_bars(self, symbol: str, start: date, stop: date, interval: str) -> DataFrame: ...


def check_window(source: BarSource, start: date, stop: date, interval: str) -> None:
    if start > stop:
        raise ValueError(f"window starts {start} after it stops {stop}")
    if interval not in source.intervals:
        raise ValueError(f"{source.name} has no interval {interval}")


def windows(start: date, stop: date, interval: str) -> list[tuple[date, date]]:
    """The window in pieces that one request may span, both ends included."""
    days = WINDOW_DAYS.get(interval, 30)
    out = []
    while start <= stop:
        end = min(stop, start + timedelta(days=days - 1))
        out.append((start, end))
        start = end + timedelta(days=1)
    return out


def translate_status(status: int) -> type[Exception] | None:
    """Error class of an HTTP status, none for success."""
    if 200 <= status < 300:
        return None
    if status in (0, 429) or status >= 500:
        return TransientError
    return {403: PermissionError, 404: LookupError}.get(status, RuntimeError)


@dataclass
class Retrying:
    """Calls again after transient errors, with doubling pauses."""

    attempts: int = 3
    backoff: float = 0.5
    longest: float = 30.0
    sleep: Callable[[float], None] = lambda _: None

    def delay(self, attempt: int) -> float:
        return min(self.backoff * 2**attempt, self.longest)

    def __call__(self, call: Callable[[], object]) -> object:
        for attempt in range(self.attempts):
            try:
                return call()
            except TransientError:
                if attempt == self.attempts - 1:
                    raise
                self.sleep(self.delay(attempt))
        raise AssertionError("unreachable")


def candle_moment(raw: Column, offset_minutes: int = 330) -> Column:
    """An epoch number as exchange-local time, or an ISO string as it is; null if neither."""
    epoch = F.when(raw.rlike(r"^\d+$"), F.timestamp_seconds(F.try_to_number(F.when(raw.rlike(r"^\d+$"), raw), F.lit("9999999999999")).cast("long")))
    local = epoch.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(offset_minutes))
    return F.coalesce(local, F.try_to_timestamp(F.regexp_replace(raw, "T", " ")).cast("timestamp_ntz"))


def candles_to_bars(candles: DataFrame, interval: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Bars and rejects of candle rows (symbol, seq, stamp, open, high, low, close, volume).

    Of equal timestamps the first stays; candles whose period has not ended at `now` are left
    out; an absent volume is zero.
    """
    typed = candles.withColumns(
        {"timestamp": candle_moment(F.col("stamp")), "volume": F.coalesce("volume", F.lit(0.0)), "interval": F.lit(interval)}
    )
    ok, bad = schema.route(typed, schema.bar_is_valid() & F.col("timestamp").isNotNull())
    first = F.row_number().over(Window.partitionBy("symbol", "timestamp").orderBy("seq"))
    kept = ok.withColumn("_p", first).where("_p = 1")
    done = kept.where(period_end(F.col("timestamp"), F.col("interval")) <= F.lit(now).cast("timestamp_ntz"))
    return done.select(*[f.name for f in schema.BAR]), bad


@dataclass
class SyntheticSource:
    """Simulated bars, one per weekday, by a process of `tidebook.sources.synthetic`."""

    spark: SparkSession
    process: str = "gaussian"
    seed: int = 1
    name: str = "synthetic"
    intervals: frozenset[str] = frozenset({"1d"})
    most: int = 20_000

    def fetch_bars(self, symbol: str, start: date, stop: date, interval: str = "1d") -> DataFrame:
        from tidebook.sources.synthetic import simulate

        check_window(self, start, stop, interval)
        days = (stop - start).days + 1
        n = sum(1 for k in range(days) if (start + timedelta(days=k)).weekday() < 5)
        if n > self.most:
            raise ValueError(f"{n} bars are more than {self.most}")
        symbols = self.spark.createDataFrame([(symbol,)], "symbol string")
        return simulate(symbols, n, self.process, self.seed, datetime(start.year, start.month, start.day, 10))
