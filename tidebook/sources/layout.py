"""A bar table whose layout spares later reads their shuffle.

Bars lie in a partition per month and, within it, in buckets of (symbol, day), each one file sorted by
symbol, day and time. What works by symbol and day (sessions, lanes of as-of joins) reads its rows where they
lie: no exchange, and no sort either while one month is read, as a bucket is then one file. A symbol's
days are in different buckets, so a symbol that most bars have is many tasks. Buckets differ at most by
how many bars one symbol has on one day.

An upsert reads and rewrites the months that it touches and leaves the files of all others alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.store import upsert_latest

#: How bars are dealt and sorted.
DEALT, SORTED = ("symbol", "day"), ("symbol", "day", "timestamp")
#: A sorted bucket that is one file counts as sorted only with the first; the second makes an overwrite replace the partitions that it writes.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"
#: Rows of the fullest month that a bucket holds on average.
ROWS_PER_BUCKET = 1_000_000
#: Months that one upsert may touch; they are named in its plan.
MOST_MONTHS = 2_400


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ordered_reads(spark: SparkSession):
    """Within it, plans that are made take sorted buckets as sorted."""
    return _setting(spark, _ORDERED, "true")


def buckets_for(rows: DataFrame, ts: str, least: int = 2) -> int:
    """Buckets for so many rows a month, from one count; `rows` may be the raw events, of which bars are fewer."""
    fullest = rows.groupBy(F.date_format(ts, "yyyy-MM")).count().agg(F.max("count")).first()[0] or 0
    return max(least, -(-fullest // ROWS_PER_BUCKET))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the day and month of their timestamp; null timestamps have a month of their own."""
    return rows.withColumn("day", F.to_date("timestamp")).withColumn("month", F.coalesce(F.date_format("timestamp", "yyyy-MM"), F.lit("none")))


class BarTable:
    """Rows with symbol and timestamp, and any other columns but day and month, under a name of the session's catalog.

    `buckets` should leave about 128 MB in a bucket of one month, and be at least the cores that work on a month.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        if not re.fullmatch(r"[A-Za-z_]\w*", name) or buckets < 1:
            raise ValueError("a table has a plain name and at least one bucket")
        self.spark, self.name, self.buckets = spark, name, buckets

    def save(self, rows: DataFrame, path: str) -> BarTable:
        """Writes all rows to a new table at `path`; one shuffle."""
        clashing = {"day", "month"} & {c.lower() for c in rows.columns}
        if clashing:
            raise ValueError(f"the layout has columns of its own named {', '.join(sorted(clashing))}")
        # dealt as buckets are, so that each bucket of a month is one file
        dealt = _placed(rows).repartition(self.buckets, *DEALT)
        dealt.write.partitionBy("month").bucketBy(self.buckets, *DEALT).sortBy(*SORTED).option("path", path).saveAsTable(self.name)
        return self

    def read(self, *months: str) -> DataFrame:
        """The rows, or those of some months ('2024-01'), with their day and month."""
        rows = self.spark.table(self.name)
        return rows.where(F.col("month").isin(*months)) if months else rows

    def upsert(self, incoming: DataFrame, arrival: str) -> list[str]:
        """One row per symbol and timestamp, the last by `arrival`; returns the months that were rewritten.

        Raises before it writes if a symbol has several intervals in the touched months, where rows have one.
        """
        fresh = _placed(incoming)
        touched = sorted(x.month for x in fresh.select("month").distinct().limit(MOST_MONTHS + 1).collect())
        if len(touched) > MOST_MONTHS:
            raise ValueError(f"an upsert touches at most {MOST_MONTHS} months")
        if not touched:
            return []
        names = self.spark.table(self.name).columns
        held = self.read(*touched)
        if "interval" in names:
            both = held.select("symbol", "interval").union(fresh.select("symbol", "interval")).groupBy("symbol")
            mixed = both.agg(F.min("interval").alias("low"), F.max("interval").alias("high")).where("low <> high").first()
            if mixed:
                raise ValueError(f"mixed intervals for {mixed.symbol}")
        # keys keep their day, so what is stored need not move to meet what comes
        merged = upsert_latest(held.drop("month"), fresh.select(*[c for c in names if c != "month"]), arrival, within=["day"])
        rows = merged.withColumn("month", F.coalesce(F.date_format("timestamp", "yyyy-MM"), F.lit("none"))).select(*names)
        with _setting(self.spark, _DYNAMIC, "dynamic"):
            rows.repartition(self.buckets, *DEALT).write.mode("overwrite").insertInto(self.name)
        return touched
