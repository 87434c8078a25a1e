"""Binary quote frames as column expressions.

A frame is a count of packets, then for each its length and bytes, all big-endian.
The length tells the mode: 8 last price, 28 index quote, 32 index full, 44 quote, 184
full with five levels of depth on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.runtime import ship_package

# Packet lengths by mode, and price divisors by segment (the low byte of the token).
MODES = {8: "ltp", 28: "index_quote", 32: "index_full", 44: "quote", 184: "full"}
DIVISORS = {3: 10_000_000.0, 6: 10_000.0}
DEFAULT_DIVISOR = 100.0
HEARTBEAT_BYTES = 2


def _number(data: Column, at: int, width: int = 4) -> Column:
    """Signed big-endian integer at a byte offset (from 0)."""
    value = F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")
    top = 1 << (8 * width)
    return F.when(value >= top // 2, value - top).otherwise(value)


def packets(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """One row per packet: the frame's other columns, position and packet; cut-off frames are an error, heartbeats give none."""
    ship_package()
    others = [c for c in frames.columns if c != frame]

    @F.arrow_udf("array<binary>")
    def cut(data: pa.Array) -> pa.Array:
        return pa.array([list(split_frame(x.as_py())) for x in data], pa.list_(pa.binary()))

    return frames.select(*others, F.posexplode(cut(frame)).alias("position", "packet"))


def split_frame(data: bytes | None) -> Iterator[bytes]:
    if not data or len(data) < HEARTBEAT_BYTES:
        return
    at = 2
    for _ in range(int.from_bytes(data[:2], "big")):
        size = int.from_bytes(data[at : at + 2], "big")
        part = data[at + 2 : at + 2 + size]
        if len(data) < at + 2 or len(part) < size:
            raise ValueError(f"frame of {len(data)} bytes is cut off at byte {at}")
        yield part
        at += 2 + size


def decode(rows: DataFrame, packet: str = "packet") -> DataFrame:
    """Adds mode, token, segment, last_price, volume, bid, ask and their quantities; unknown lengths have mode null."""
    data = F.col(packet)
    size = F.octet_length(data)
    mode = F.coalesce(*[F.when(size == n, F.lit(m)) for n, m in MODES.items()])
    token = _number(data, 0)
    segment = token.bitwiseAND(F.lit(0xFF))
    divisor = F.coalesce(*[F.when(segment == k, F.lit(v)) for k, v in DIVISORS.items()], F.lit(DEFAULT_DIVISOR))
    price = lambda at: _number(data, at) / divisor
    traded, full = size.isin(44, 184), size == 184
    return rows.select(
        "*",
        mode.alias("mode"),
        token.alias("token"),
        segment.cast("int").alias("segment"),
        price(4).alias("last_price"),
        F.when(traded, _number(data, 16)).alias("volume"),
        F.when(full, _number(data, 64)).alias("bid_quantity"),
        F.when(full, price(68)).alias("bid"),
        F.when(full, _number(data, 124)).alias("ask_quantity"),
        F.when(full, price(128)).alias("ask"),
        F.when(full, F.timestamp_seconds(_number(data, 60)).cast("timestamp_ntz")).alias("exchange_timestamp"),
    )


def depth(packet: Column) -> Column:
    """Array of the ten levels of a full packet: side, quantity, price in units and orders."""
    levels = []
    for k in range(10):
        at = 64 + 12 * k
        levels.append(
            F.struct(
                F.lit("buy" if k < 5 else "sell").alias("side"),
                _number(packet, at).alias("quantity"),
                _number(packet, at + 4).alias("price"),
                _number(packet, at + 8, 2).alias("orders"),
            )
        )
    return F.when(F.octet_length(packet) == 184, F.array(*levels))


def to_quotes(decoded: DataFrame) -> DataFrame:
    """Decoded packets as quotes; a side without quantity or price is absent."""
    side = lambda price, quantity: F.when((F.col(price) > 0) & (F.col(quantity) > 0), F.col(price))
    return decoded.where("last_price > 0").select(
        F.col("token").cast("string").alias("symbol"),
        F.col("exchange_timestamp").alias("timestamp"),
        "last_price",
        side("bid", "bid_quantity").alias("bid"),
        side("ask", "ask_quantity").alias("ask"),
        "bid_quantity",
        "ask_quantity",
        F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"),
    )
