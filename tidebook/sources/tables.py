"""The star-schema tables as ticks, quotes and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: symbol, ts, price, volume, event_id, user_id; values that are no price are left out."""
    return table(spark, sf_dir, "events").where("value > 0").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        "event_id",
        "user_id",
    )


def ohlcv(rows: DataFrame, bucket: Column, order: list[str], interval: str) -> DataFrame:
    """Bars from rows with symbol, price and volume; `order` decides first and last within a bucket."""
    moment = F.struct(*order)
    return (
        rows.groupBy("symbol", bucket.alias("timestamp"))
        .agg(
            F.min_by("price", moment).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", moment).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumn("interval", F.lit(interval))
    )


def tumbling(ts: Column, every: str) -> Column:
    """Start of the bucket of absolute time that ts falls in."""
    return F.window(ts, every)["start"]


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(ticks(spark, sf_dir), tumbling(F.col("ts"), "1 hour"), ["ts", "event_id"], "1h")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(ticks(spark, sf_dir), tumbling(F.col("ts"), "1 day"), ["ts", "event_id"], "1d")


def shipment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by part type and ship day as long daily bars; price is the unit price."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_type").alias("symbol"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("volume"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_extendedprice",
        )
    )
    return ohlcv(rows, tumbling(F.col("ts"), "1 day"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "1d")
