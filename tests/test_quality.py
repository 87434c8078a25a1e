"""Planted faults: gaps among all bars, and every check in the verdict."""

import math
from datetime import datetime, timedelta

import __spark_entry__ as entry
from tidebook.operators import quality

START = datetime(2024, 1, 1)  # a Monday


def weekdays(n: int) -> list[datetime]:
    days = (START + timedelta(days=k) for k in range(2 * n + 7))
    return [d for d in days if d.weekday() < 5][:n]


def test_gaps_are_those_of_all_bars(spark, tmp_path):
    def folder(name: str, days: list[datetime]) -> str:
        path = str(tmp_path / name)
        spark.createDataFrame([(1, "T")], "p_partkey long, p_type string").write.parquet(f"{path}/part.parquet")
        rows = [(k, 1, 1, 1.0, 10.0 + k, d) for k, d in enumerate(days)]
        lineitem = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
        spark.createDataFrame(rows, lineitem).write.parquet(f"{path}/lineitem.parquet")
        return path

    days = weekdays(40)
    run = lambda path: [(r["at"], r.observed) for r in entry.queries()["quality_calendar_gap_all"](spark, path).collect()]
    # one Monday missing is no gap; Tuesday to the Thursday of the next week is one of eight days, at the Friday
    assert run(folder("a", [d for k, d in enumerate(days) if k != 5])) == []
    assert run(folder("b", [d for k, d in enumerate(days) if not 6 <= k <= 13])) == [(days[14], 8.0)]


def test_every_check_reaches_the_verdict(spark):
    days = weekdays(60)
    wave = lambda k: 100 * math.exp(0.01 * math.sin(k))
    rows = []
    for symbol in ("fine", "split", "spike", "twice", "stale", "gap", "back", "short", "still", "quiet"):
        for k, day in enumerate(days):
            close, volume, arrival = wave(k), 1000.0, k
            if symbol == "split" and k >= 30:
                close /= 2
            if symbol == "spike" and k == 30:
                close *= 1.25
            if symbol == "stale" and 20 <= k < 26:
                close = 100.0
            if symbol == "back" and k == 30:
                arrival = 10_000
            if symbol == "still" and k % 5 == 0 or symbol == "quiet" and k == 3:
                volume = 0.0
            if symbol == "short" and k >= 10 or symbol == "gap" and 20 <= k < 28:
                continue
            rows += [(symbol, day, close, volume, arrival)] * (2 if symbol == "twice" and k == 30 else 1)
    bars = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, volume double, arrival long")
    got = {r.symbol: (r.n_error, r.n_warning, r.n_info, r.is_usable) for r in quality.summary(quality.report(bars, "arrival"), bars).collect()}
    assert got == {
        "fine": (0, 0, 0, True),
        "split": (1, 0, 0, False),
        "spike": (0, 2, 0, True),
        "twice": (1, 0, 0, False),
        "stale": (0, 1, 0, True),
        "gap": (0, 1, 0, True),
        "back": (0, 0, 1, True),
        "short": (1, 0, 0, False),
        "still": (1, 0, 0, False),
        "quiet": (0, 1, 0, True),
    }
