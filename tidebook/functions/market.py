"""Column expressions of bars, quotes, calendars and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BARS_PER_YEAR = 252
ANNUALISER = BARS_PER_YEAR**0.5


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def turnover() -> Column:
    return typical_price() * F.col("volume")


def bar_range() -> Column:
    """High less low; a gap from the bar before does not count."""
    return F.col("high") - F.col("low")


def mid() -> Column:
    return (F.col("bid") + F.col("ask")) / 2


def spread() -> Column:
    return F.col("ask") - F.col("bid")


def spread_bps() -> Column:
    """Spread in basis points of the mid; null unless both sides are there."""
    return 10_000 * spread() / mid()


def round_to_tick(price: Column, tick: Column) -> Column:
    """The nearest multiple of the tick, halves to the even multiple, at four decimals."""
    return F.round(F.bround(price / tick) * tick, 4)


def instrument_key(exchange: Column, symbol: Column) -> Column:
    return F.concat(exchange, F.lit(":"), symbol)


def annualise(volatility: Column) -> Column:
    return volatility * ANNUALISER


def deannualise(volatility: Column) -> Column:
    return volatility / ANNUALISER


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def period_end(start: Column, interval: Column, close_time: str = "15:30:00") -> Column:
    """When a bar that starts at `start` is complete: session close for a day, else the interval's end."""
    minutes = F.regexp_extract(interval, r"^(\d+)m$", 1)
    close = F.to_timestamp_ntz(F.concat(F.date_format(start, "yyyy-MM-dd "), F.lit(close_time)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (
        F.when(interval == "1d", close)
        .when(interval == "1w", start + F.expr("INTERVAL 7 DAYS"))
        .when(interval == "1mo", start + F.expr("INTERVAL 1 MONTH"))
        .when(interval == "1h", start + F.expr("INTERVAL 1 HOUR"))
        .when(interval == "4h", start + F.expr("INTERVAL 4 HOURS"))
        .when(minutes != "", start + F.make_dt_interval(mins=F.try_to_number(F.when(minutes != "", minutes), F.lit("999999")).cast("int")))
    )


def exchange_time(utc: Column, offset_minutes: int = 330) -> Column:
    return utc + F.make_dt_interval(mins=F.lit(offset_minutes))


def is_open(moment: Column, opens: str = "09:15:00", closes: str = "15:30:00") -> Column:
    """Weekday, and between the opening and closing times, both included."""
    clock = F.date_format(moment, "HH:mm:ss.SSSSSS")
    return is_weekday(moment) & clock.between(f"{opens}.000000", f"{closes}.000000")


def same_session(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def cash_flow() -> Column:
    """Cash that a fill moves: paid for a buy, received for a sale, commission off either."""
    notional = F.col("quantity") * F.col("price")
    return F.when(F.col("side") == "buy", -notional).otherwise(notional) - F.col("commission")


def signed_quantity() -> Column:
    return F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))


def unrealised_pnl() -> Column:
    return F.col("quantity") * (F.col("last_price") - F.col("average_price"))
