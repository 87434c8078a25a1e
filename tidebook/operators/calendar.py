"""Trading calendars: holidays, special sessions, and the years they speak for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.market import is_weekday

# Exchange holidays and special sessions by year.
HOLIDAYS = """
2025-02-26 2025-03-14 2025-03-31 2025-04-10 2025-04-14 2025-04-18 2025-05-01 2025-08-15 2025-08-27 2025-10-02
2025-10-21 2025-10-22 2025-11-05 2025-12-25
2026-01-15 2026-01-26 2026-03-03 2026-03-26 2026-03-31 2026-04-03 2026-04-14 2026-05-01 2026-05-28 2026-06-26 2026-09-14
2026-10-02 2026-10-20 2026-11-10 2026-11-24 2026-12-25
""".split()
SPECIAL_SESSIONS = ("2025-10-21", "2026-11-08")
#: Days between the first and the last day of a table that one task may number and a broadcast may hold; some 2,700 years.
MOST_DAYS = 1_000_000


@dataclass(frozen=True)
class TradingCalendar:
    """Days that are closed although weekdays, days that trade although they would not, and covered years."""

    holidays: frozenset[date] = frozenset()
    specials: frozenset[date] = frozenset()
    years: frozenset[int] = frozenset()
    sources: tuple[str, ...] = field(default=())

    @classmethod
    def exchange(cls) -> TradingCalendar:
        return cls(
            frozenset(map(date.fromisoformat, HOLIDAYS)),
            frozenset(map(date.fromisoformat, SPECIAL_SESSIONS)),
            frozenset({2025, 2026}),
            ("exchange holiday circulars",),
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """day and special of every exceptional day."""
        rows = [(d, True) for d in sorted(self.specials)] + [(d, False) for d in sorted(self.holidays - self.specials)]
        return spark.createDataFrame(rows, "day date, special boolean")

    def _among(self, day: Column, days: frozenset[date]) -> Column:
        return day.isin([F.lit(d) for d in sorted(days)]) if days else F.lit(False)

    def trading_day(self, day: Column, strict: bool = True) -> Column:
        """Special sessions trade, holidays do not, else weekdays do.

        A day of a year that is not covered raises, or with strict off falls back to the weekday.
        """
        known = F.when(self._among(day, self.specials), True).when(self._among(day, self.holidays), False).otherwise(is_weekday(day))
        covered = F.year(day).isin(sorted(self.years)) if self.years else F.lit(False)
        message = F.concat(F.lit("the calendar does not cover "), day.cast("string"))
        other = F.raise_error(message).cast("boolean") if strict else is_weekday(day)
        return F.when(day.isNull(), None).when(covered, known).otherwise(other)

    def full_session(self, day: Column, strict: bool = True) -> Column:
        return self.trading_day(day, strict) & ~self._among(day, self.specials)


def load_calendar(spark: SparkSession, path: str, years: list[int], sources: list[str]) -> TradingCalendar:
    """A calendar from a file with an ISO date on each line; `#` starts a comment. Years and sources are mandatory."""
    if not years or not sources:
        raise ValueError("a calendar must name the years that it covers and its sources")
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("d")).where("d <> ''")
    days = [r.day for r in lines.select(F.col("d").cast("date").alias("day")).collect()]
    return TradingCalendar(frozenset(days), years=frozenset(years), sources=tuple(sources))


def trading_days(spark: SparkSession, calendar: TradingCalendar, start: str, count: int) -> DataFrame:
    """The first `count` trading days from `start` on, in order.

    Every week has five weekdays and a calendar closes a known number of days, so the span
    that holds `count` days is known beforehand however long closures are.
    """
    span = 7 * ((count + len(calendar.holidays)) // 5 + 2)
    days = spark.range(span).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    return days.where(calendar.trading_day(F.col("day"), strict=False)).orderBy("day").limit(count)


def sessions_from(rows: DataFrame, day: str, calendar: TradingCalendar, count: int, name: str = "sessions") -> DataFrame:
    """`rows` with an array of the first `count` trading days on or after a date column; null dates have none.

    The days between the smallest and the largest date are numbered once, and that table, whose rows
    follow from the dates' range and are checked, is broadcast: rows stay where they are. Days of years that the
    calendar does not cover go by their weekday.
    """
    if count < 1:
        raise ValueError("at least one trading day is asked for")
    low, high = rows.agg(F.min(day), F.max(day)).first()
    if low is None:
        return rows.withColumn(name, F.lit(None).cast("array<date>"))
    reach = 7 * ((count + len(calendar.holidays)) // 5 + 2)
    if (high - low).days + reach > MOST_DAYS:
        raise ValueError(f"dates from {low} to {high} span more than {MOST_DAYS} days")
    spark = rows.sparkSession
    span = spark.range((high - low).days + reach + 1).select(F.date_add(F.lit(low), F.col("id").cast("int")).alias("_day"))
    ahead = Window.orderBy("_day").rowsBetween(0, reach)
    trades = F.when(calendar.trading_day(F.col("_day"), strict=False), F.col("_day"))
    table = span.select("_day", F.slice(F.collect_list(trades).over(ahead), 1, count).alias(name)).where(F.col("_day") <= F.lit(high))
    return rows.join(F.broadcast(table), rows[day] == F.col("_day"), "left").drop("_day")


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates, by arithmetic."""

    def before(d: Column) -> Column:
        """Weekdays from Monday 1970-01-05 up to d, d left out."""
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.greatest(before(b) - before(F.date_add(a, 1)), F.lit(0))
