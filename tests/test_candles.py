"""Candles of a vendor through the data source."""

from datetime import date, datetime, timedelta

import pytest

from tidebook.sources import candles
from tidebook.sources.vendors import TransientError, windows


def vendor(log: str):
    """A stub: 'gone' is unknown, 'empty' has nothing, 'flaky' answers the second time, 'down' never, 'half' fails in its last window."""

    def client(symbol, start, stop, interval):
        with open(log, "a") as f:
            f.write(f"{symbol} {start}\n")
        with open(log) as f:
            asked = f.read().count(f"{symbol} {start}\n")
        if symbol == "gone":
            raise LookupError("no such symbol")
        if symbol == "down" or (symbol == "flaky" and asked < 2):
            raise TransientError("busy")
        if symbol == "half" and stop == date(2024, 12, 31):
            raise PermissionError("no right")
        if symbol == "empty":
            return []
        days = [start + timedelta(days=k) for k in range((stop - start).days + 1)]
        rows = [(f"{d}T10:00:00", 1.0, 2.0, 0.5, 1.5, None if d.day == 1 else 9) for d in days]
        # a repeated candle, and one that is no bar
        return rows + [(f"{stop}T10:00:00", 1.0, 3.0, 0.5, 1.5, 9)] + ([(f"{stop}T11:00:00", 5.0, 2.0, 0.5, 1.5, 9)] if symbol == "odd" else [])

    return client


def test_one_job_fetches_all_symbols_and_failures_are_rows(spark, tmp_path):
    log = str(tmp_path / "asked")
    open(log, "w").close()
    symbols = ["a", "b", "gone", "empty", "flaky", "down", "half", "odd", "a"]
    span = (date(2024, 1, 1), date(2024, 12, 31))
    found = candles.candles(spark, vendor(log), symbols, *span, "1d", attempts=2, backoff=0.01)
    n_windows = len(windows(*span, "1d"))
    assert found.rdd.getNumPartitions() == 8 * n_windows
    bars, bad, report = candles.ingest(found, str(tmp_path / "held"), "1d", "2025-06-01 00:00:00")
    told = {r.symbol: (r.rows > 0, r.requests, r.failed, r.failure) for r in report.collect()}
    assert told == {
        **{s: (True, n_windows, 0, None) for s in ("a", "b", "flaky", "odd")},
        "gone": (False, n_windows, n_windows, "no such symbol"),
        "down": (False, n_windows, n_windows, "busy"),
        "empty": (False, n_windows, 0, "vendor returned no bars"),
        "half": (True, n_windows, 1, "no right"),
    }
    got = {r.symbol: r["count"] for r in bars.groupBy("symbol").count().collect()}
    assert got == {s: 366 for s in ("a", "b", "flaky", "odd")}
    assert bars.where("volume = 0").count() == 12 * 4 and bars.where("high > 2").count() == 0
    assert {r.symbol for r in bad.collect()} == {"odd"} and bad.count() == n_windows
    # nothing asks the vendor again, and each request was made once but for retries
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == n_windows * (8 + 2)


def test_candles_of_a_period_that_has_not_ended_stay_out(spark, tmp_path):
    found = candles.candles(spark, vendor(str(tmp_path / "asked")), ["a"], date(2024, 1, 1), date(2024, 1, 10))
    bars, _, _ = candles.ingest(found, str(tmp_path / "held"), "1d", "2024-01-05 09:00:00")
    assert max(r.timestamp for r in bars.collect()) < datetime(2024, 1, 5)
    with pytest.raises(ValueError):
        candles.candles(spark, vendor(""), ["a"], date(2024, 2, 1), date(2024, 1, 1))
