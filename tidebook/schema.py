"""Record types, their invariants as columns, and the closed sets of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("interval", T.StringType()),
    ]
)
QUOTE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("last_price", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid_quantity", T.LongType()),
        T.StructField("ask_quantity", T.LongType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
COMPONENT = T.StructType(
    [
        T.StructField("w", T.DoubleType()),
        T.StructField("loc", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("df", T.DoubleType()),
    ]
)
MIXTURE = T.ArrayType(COMPONENT)
JOURNAL = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("schema", T.IntegerType()),
        T.StructField("as_of", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("approved", T.DoubleType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("filled", T.DoubleType()),
        T.StructField("fill_price", T.DoubleType()),
        T.StructField("fees", T.DoubleType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("cash", T.DoubleType()),
    ]
)

# Slugs of the closed sets.
SIDES = ("buy", "sell")
ACTIONS = ("buy", "sell", "no_trade")
ORDER_TYPES = ("market", "limit", "stop_loss", "stop_loss_market")
ORDER_STATUSES = ("pending", "open", "partially_filled", "filled", "cancelled", "rejected")
REGIMES = ("bullish", "bearish", "neutral")
CHECK_STATUSES = ("pass", "fail", "skipped")
REASONS = (
    "edge_too_small",
    "uncertainty_too_high",
    "model_disagreement",
    "loss_probability_too_high",
    "stale_posterior",
    "insufficient_data",
)


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def positive(x: Column) -> Column:
    return finite(x) & F.coalesce(x > 0, F.lit(False))


def bar_is_valid() -> Column:
    """Prices finite and positive, volume finite and not negative, and open and close within low and high."""
    o, h, low, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    return (
        F.coalesce(F.length("symbol") > 0, F.lit(False))
        & positive(o) & positive(h) & positive(low) & positive(c)
        & finite(v) & F.coalesce(v >= 0, F.lit(False))
        & (h >= low) & o.between(low, h) & c.between(low, h)
    )


def quote_is_valid() -> Column:
    """Last price finite and positive, sides positive where given, quantities and volume not negative, book not crossed."""
    bid, ask = F.col("bid"), F.col("ask")
    return (
        positive(F.col("last_price"))
        & (bid.isNull() | positive(bid))
        & (ask.isNull() | positive(ask))
        & F.coalesce(bid <= ask, F.lit(True))
        & F.coalesce(F.col("bid_quantity") >= 0, F.lit(True))
        & F.coalesce(F.col("ask_quantity") >= 0, F.lit(True))
        & F.coalesce(finite(F.col("volume")) & (F.col("volume") >= 0), F.lit(False))
    )


def route(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that hold the invariant, and the rejects."""
    return df.where(valid), df.where(~valid)
