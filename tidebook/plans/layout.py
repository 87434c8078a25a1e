"""Queries over stored bars: tables whose rows lie where reads need them, and text files whose rejects name their line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators import store
from tidebook.plans.registry import HOURLY, query, r, rounded
from tidebook.runtime import shared_dir
from tidebook.sources import bars as bar_files
from tidebook.sources import tables
from tidebook.sources.layout import BarTable, buckets_for, ordered_reads


def _table(spark: SparkSession, name: str, rows: DataFrame, buckets: int) -> BarTable:
    """A table of its own for one run, in the shared folder."""
    name = f"{name}_{uuid.uuid4().hex}"
    return BarTable(spark, name, buckets).save(rows, f"{shared_dir(spark)}/{name}")


def corrections(bars: DataFrame) -> DataFrame:
    """What arrives after the bars, by rule: late and equal arrivals win, stale ones lose, some bars are new."""
    hour, day = F.hour("timestamp"), F.dayofmonth("timestamp")
    half = F.col("timestamp") + F.expr("INTERVAL 30 MINUTES")
    kinds = F.array_compact(
        F.array(
            F.when((day % 10 == 3) & (hour % 2 == 0), F.struct(F.lit(2).alias("seen"), F.lit(1.001).alias("by"), F.col("timestamp").alias("at"))),
            F.when((day % 10 == 4) & (hour % 2 == 0), F.struct(F.lit(1).alias("seen"), F.lit(0.999).alias("by"), F.col("timestamp").alias("at"))),
            F.when(hour % 12 == 7, F.struct(F.lit(0).alias("seen"), F.lit(2.0).alias("by"), F.col("timestamp").alias("at"))),
            F.when(hour % 12 == 5, F.struct(F.lit(1).alias("seen"), F.lit(1.0).alias("by"), half.alias("at"))),
        )
    )
    names = [c for c in bars.columns if c not in ("timestamp", "close", "seen")]
    rows = bars.select(*names, "close", F.inline(kinds))
    return rows.select(*names, F.col("at").alias("timestamp"), (F.col("close") * F.col("by")).alias("close"), "seen")


SESSIONS_SQL = f"""WITH {HOURLY}, fixed AS (
        SELECT symbol, timestamp, open, high, low, volume, close * CASE WHEN hour(timestamp) % 2 = 1 THEN 1 WHEN day(timestamp) % 10 = 3 THEN 1.001
               WHEN day(timestamp) % 10 = 4 THEN 0.999 ELSE 1 END AS close FROM bars
        UNION ALL SELECT symbol, timestamp + INTERVAL 30 MINUTE, open, high, low, volume, close FROM bars WHERE hour(timestamp) % 12 = 5)
    SELECT symbol, timestamp, {r("close", "close")}, row_number() OVER s AS n, {r("max(high) OVER s", "session_high")},
           {r("sum(close * volume) OVER s / nullif(sum(volume) OVER s, 0)", "session_vwap")}, {r("close / first_value(open) OVER s - 1", "since_open")}
    FROM fixed WINDOW s AS (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"""


@query("layout_sessions", SESSIONS_SQL)
def layout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars stored, corrected by an upsert and read by session, without an exchange."""
    bars = tables.hourly_bars(spark, sf_dir).withColumn("seen", F.lit(1))
    held = _table(spark, "bars", bars, buckets_for(tables.ticks(spark, sf_dir), "ts"))
    held.upsert(corrections(bars), "seen")
    s = Window.partitionBy("symbol", "day").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    with ordered_reads(spark):
        out = rounded(
            held.read().select(
                "symbol",
                "timestamp",
                "close",
                F.row_number().over(Window.partitionBy("symbol", "day").orderBy("timestamp")).cast("long").alias("n"),
                F.max("high").over(s).alias("session_high"),
                F.try_divide(F.sum(F.col("close") * F.col("volume")).over(s), F.sum("volume").over(s)).alias("session_vwap"),
                (F.col("close") / F.first("open").over(s) - 1).alias("since_open"),
            )
        )
        out._jdf.queryExecution().executedPlan()
    return out


@query(
    "layout_asof",
    f"""WITH {HOURLY}, closed AS (SELECT symbol, timestamp + INTERVAL 1 HOUR AS timestamp, close FROM bars)
    SELECT event_id, ticks.symbol, {r("price", "price")}, {r("closed.close", "close")} FROM ticks ASOF LEFT JOIN closed ON ticks.symbol = closed.symbol AND ticks.ts >= closed.timestamp""",
)
def layout_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick with the close of the last bar that had ended, from two tables in one layout: neither side moves."""
    ticks = tables.ticks(spark, sf_dir)
    buckets = buckets_for(ticks, "ts")
    left = _table(spark, "ticks", ticks.select("symbol", F.col("ts").alias("timestamp"), "event_id", "price"), buckets)
    ended = F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    right = _table(spark, "closed", tables.hourly_bars(spark, sf_dir).select("symbol", ended.alias("timestamp"), "close"), buckets)
    met = store.as_of_join(left.read(), right.read(), "symbol", "timestamp", "timestamp", "close", lanes="day")
    return rounded(met.select("event_id", "symbol", "price", "close"))


@query(
    "csv_rejects",
    f"""WITH {HOURLY}, placed AS (SELECT *, strftime(timestamp, '%Y-%m-%d') AS day, hour(timestamp) AS h,
        row_number() OVER (PARTITION BY timestamp::DATE ORDER BY symbol, timestamp) + 1 AS line FROM bars)
    SELECT day, line, symbol, CASE WHEN h % 11 = 3 THEN 'time' ELSE 'prices' END AS fault FROM placed WHERE h % 11 = 3 OR h % 7 = 5""",
)
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as text files, some with a time or prices that no bar has, read again: the file and line of each reject."""
    hour, path = F.hour("timestamp"), f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    bars = tables.hourly_bars(spark, sf_dir).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    spoilt = bars.select(
        "day",
        "symbol",
        F.col("timestamp").alias("_at"),
        F.when(hour % 11 == 3, F.concat(F.lit("at "), text)).otherwise(text).alias("timestamp"),
        F.when(hour % 7 == 5, F.col("high") + 1).otherwise(F.col("open")).alias("open"),
        *bar_files.COLUMNS[3:],
    )
    # a file per day, in order, so that SQL knows the lines
    laid = spoilt.repartition("day").sortWithinPartitions("day", "symbol", "_at").drop("_at")
    laid.write.partitionBy("day").option("header", True).csv(path)
    _, bad = bar_files.read_bars(spark, path)
    return bad.select(
        F.regexp_extract("_path", r"day=([\d-]+)", 1).alias("day"),
        F.col("_line").alias("line"),
        F.split("_text", ",")[0].alias("symbol"),
        F.when(F.col("timestamp").isNull(), "time").otherwise("prices").alias("fault"),
    )
