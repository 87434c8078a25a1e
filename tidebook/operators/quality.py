"""Data-quality checks over bars: findings with check, severity, symbol, at and observed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.calendar import TradingCalendar, weekdays_between

MIN_BARS, MAX_GAP_DAYS, STALE_RUN, SPIKE_SIGMAS, MIN_ZERO_SHARE = 30, 5, 5, 12.0, 10
# Split ratios in the order they are tried, and the tolerance in log space.
SPLIT_RATIOS, SPLIT_TOLERANCE = (2.0, 3.0, 4.0, 5.0, 10.0, 1.5, 2.5), 0.08
MAD_SCALE = 1.4826


def _finding(rows: DataFrame, check: str | Column, severity: str | Column, at: Column | None, observed: Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        as_column(check).alias("check"),
        as_column(severity).alias("severity"),
        "symbol",
        (F.lit(None).cast("timestamp_ntz") if at is None else at).alias("at"),
        observed.cast("double").alias("observed"),
    )


def duplicates(bars: DataFrame) -> DataFrame:
    rows = bars.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _finding(rows, "duplicate_timestamp", "error", F.col("timestamp"), F.col("n"))


def unordered(bars: DataFrame, arrival: str) -> DataFrame:
    """Symbols whose rows did not arrive in time order, with the number of steps back."""
    before = F.lag("timestamp").over(Window.partitionBy("symbol").orderBy(arrival))
    rows = bars.select("symbol", (F.col("timestamp") < before).alias("back")).groupBy("symbol").agg(F.count_if("back").alias("n"))
    return _finding(rows.where("n > 0"), "unordered_series", "info", None, F.col("n"))


def insufficient_history(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    rows = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return _finding(rows, "insufficient_history", "error", None, F.col("n"))


def calendar_gaps(bars: DataFrame, calendar: TradingCalendar | None = None, most: int = MAX_GAP_DAYS) -> DataFrame:
    """Bars that follow more than `most` trading days without one.

    Weekdays between come from arithmetic; a calendar's exceptional days in the gap
    correct the number, and days that it does not cover count as weekdays.
    """
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    day = F.to_date("timestamp")
    gaps = bars.select("symbol", "timestamp", F.lag(day).over(ordered).alias("a"), day.alias("b")).where("a IS NOT NULL")
    days = weekdays_between(F.col("a"), F.col("b"))
    if calendar is not None:
        closed = [d for d in sorted(calendar.holidays - calendar.specials) if d.weekday() < 5]
        opened = [d for d in sorted(calendar.specials) if d.weekday() >= 5]
        within = lambda found: F.size(
            F.filter(F.lit(found).cast("array<date>") if found else F.array().cast("array<date>"), lambda d: (d > F.col("a")) & (d < F.col("b")))
        )
        # a day lies between two bars only where they are more than a weekend apart
        days = F.when(F.datediff("b", "a") > 1, days - within(closed) + within(opened)).otherwise(days)
    rows = gaps.withColumn("n", days).where(F.col("n") > most)
    return _finding(rows, "calendar_gap", "warning", F.col("timestamp"), F.col("n"))


def zero_volume(bars: DataFrame) -> DataFrame:
    """Symbols with bars of no volume: an error from over a tenth of the bars on."""
    rows = bars.groupBy("symbol").agg(F.count_if(F.col("volume") == 0).alias("n"), F.count(F.lit(1)).alias("all")).where("n > 0")
    severity = F.when(F.col("n") > F.floor(F.col("all") / MIN_ZERO_SHARE), "error").otherwise("warning")
    return _finding(rows, "zero_volume", severity, None, F.col("n"))


def stale_prices(bars: DataFrame, least: int = STALE_RUN) -> DataFrame:
    """Runs of at least `least` equal closes, by gaps and islands; `at` is the run's last bar."""
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    starts = bars.withColumn("new", (~F.col("close").eqNullSafe(F.lag("close").over(ordered))).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("symbol", "island").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("to"))
    return _finding(runs.where(F.col("n") >= least), "stale_price", "warning", F.col("to"), F.col("n"))


def price_jumps(bars: DataFrame, sigmas: float = SPIKE_SIGMAS) -> DataFrame:
    """Returns at least `sigmas` robust deviations from the median: splits where the ratio fits, else spikes."""
    ordered = Window.partitionBy("symbol").orderBy("timestamp")
    r = F.ln(F.try_divide("close", F.lag("close").over(ordered)))
    returns = bars.select("symbol", "timestamp", r.alias("r")).where("r IS NOT NULL")
    middle = returns.groupBy("symbol").agg(F.percentile("r", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))
    around = returns.join(middle, "symbol").withColumn("away", F.abs(F.col("r") - F.col("median")))
    spread = around.groupBy("symbol").agg(F.percentile("away", F.lit(0.5)).alias("mad"))
    rows = (
        around.join(spread, "symbol")
        .where((F.col("n") + 1 >= 3) & (F.col("mad") > 0))
        .withColumn("score", F.col("away") / (MAD_SCALE * F.col("mad")))
        .where(F.col("score") >= sigmas)
    )
    ratio = F.coalesce(
        *[F.when(F.abs(F.abs(F.col("r")) - F.ln(F.lit(k))) <= SPLIT_TOLERANCE, F.lit(k)) for k in SPLIT_RATIOS]
    )
    split = ratio.isNotNull()
    return _finding(
        rows,
        F.when(split, "suspected_split").otherwise("price_spike"),
        F.when(split, "error").otherwise("warning"),
        F.col("timestamp"),
        F.col("score"),
    )


def report(bars: DataFrame, arrival: str, calendar: TradingCalendar | None = None, least: int = MIN_BARS) -> DataFrame:
    """All findings of all checks."""
    parts = [
        duplicates(bars),
        unordered(bars, arrival),
        insufficient_history(bars, least),
        calendar_gaps(bars, calendar),
        zero_volume(bars),
        stale_prices(bars),
        price_jumps(bars),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol of `symbols`: errors, warnings, infos, and whether it is usable (no error)."""
    counts = findings.groupBy("symbol").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")])
    joined = symbols.select("symbol").distinct().join(counts, "symbol", "left").na.fill(0)
    return joined.withColumn("is_usable", F.col("n_error") == 0)
