"""Point-in-time scans and upserts over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moment(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def upsert_latest(stored: DataFrame, incoming: DataFrame, arrival: str, within: list[str] | None = None) -> DataFrame:
    """One row per (symbol, timestamp): the last by `arrival`; incoming rows beat stored ones on ties.

    Raises at run time if a symbol mixes intervals, where rows have one. `within` names columns that follow from the
    timestamp and that a stored layout deals rows by; intervals are then compared within them.
    """
    within = within or []
    names = [c for c in stored.columns if c not in ("symbol", "timestamp", *within)]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    kept = both.groupBy("symbol", *within, "timestamp").agg(F.max_by(F.struct(*names), F.struct(arrival, "_new")).alias("r"))
    rows = kept.select("symbol", "timestamp", *within, "r.*")
    if "interval" not in names:
        return rows
    per_symbol = Window.partitionBy("symbol", *within)
    mixed = F.min("interval").over(per_symbol) != F.max("interval").over(per_symbol)
    return rows.withColumn(
        "interval", F.when(mixed, F.raise_error(F.concat(F.lit("mixed intervals for "), "symbol"))).otherwise(F.col("interval"))
    )


def history(bars: DataFrame, as_of: str, since: str | None = None, count: int | None = None) -> DataFrame:
    """Rows known at `as_of`, from `since` on (both inclusive), at most the last `count` of each symbol."""
    if count is not None and count < 0:
        raise ValueError("count must not be negative")
    rows = bars.where(F.col("timestamp") <= _moment(as_of))
    if since is not None:
        rows = rows.where(F.col("timestamp") >= _moment(since))
    return rows if count is None else _ranked(rows, count, F.col("timestamp").desc())


def upcoming(bars: DataFrame, after: str, count: int) -> DataFrame:
    """The first `count` rows of each symbol strictly after a moment."""
    return _ranked(bars.where(F.col("timestamp") > _moment(after)), count, F.col("timestamp").asc())


def _ranked(rows: DataFrame, count: int, order: Column) -> DataFrame:
    # a rank filter on row_number lets Spark keep only `count` rows per symbol before the shuffle
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


def load_range(bars: DataFrame, start: str, stop: str) -> DataFrame:
    return bars.where(F.col("timestamp").between(_moment(start), _moment(stop)))


def align(bars: DataFrame, as_of: str, symbols: list[str] | None = None) -> DataFrame:
    """The latest row of each symbol known at `as_of`; symbols without one are left out, nothing is filled."""
    rows = bars.where(F.col("timestamp") <= _moment(as_of))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    names = [c for c in bars.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*names), "timestamp").alias("r")).select("symbol", "r.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, lane: str = "day", lanes: str | None = None) -> DataFrame:
    """`left` with the `value` of the latest right row of the key at or before it, null without one.

    Both sides meet in one sorted stream, right rows first at equal times; no pairs are
    made. The stream is cut into lanes of time, and a table with the last value of each
    (key, lane) carries values on, so that one key's history is not one task. Of right
    rows at one moment the greatest value counts; null values are passed over
    and null keys meet nothing. `lanes` names a column of both sides that follows from their times and rises
    with them, in place of truncated times: where both are stored in buckets of (key, lanes), rows stay where they lie.
    """
    own = lambda ts: F.col(lanes) if lanes else F.date_trunc(lane, ts)
    # key and lane appear once, as a union keeps the partitioning of its sides only where both have just one
    named = {key: "_k"} | ({lanes: "_lane"} if lanes else {})
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns if c not in named])
    tagged_left = left.select(
        F.col(key).alias("_k"), own(left_ts).alias("_lane"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"), row.alias("_row")
    )
    tagged_right = (
        right.select(F.col(key).alias("_k"), own(right_ts).alias("_lane"), F.col(right_ts).alias("_t"), F.col(value).alias("_v"))
        .groupBy("_k", "_lane", "_t")
        .agg(F.max("_v").alias("_v"))
        .select("_k", "_lane", "_t", F.lit(0).alias("_side"), "_v")
    )
    stream = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
    ends = stream.groupBy("_k", "_lane").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy("_k").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_k").alias("_ck"), F.col("_lane").alias("_cl"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry")
    )
    within = Window.partitionBy("_k", "_lane").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = stream.withColumn("_near", F.last("_v", ignorenulls=True).over(within)).where("_side = 1")
    # nothing is carried to a null key or a null time
    same = (met["_k"] == carried["_ck"]) & (met["_lane"] == carried["_cl"])
    columns = [F.col(named[c]).alias(c) if c in named else F.col(f"_row.`{c}`") for c in left.columns]
    return met.join(carried, same, "left").select(*columns, F.when(F.col("_k").isNotNull(), F.coalesce("_near", "_carry")).alias(value))


def coverage(bars: DataFrame) -> DataFrame:
    """Per symbol: interval, first and last timestamp, number of bars."""
    return bars.groupBy("symbol").agg(
        F.min("interval").alias("interval"),
        F.min("timestamp").alias("first_bar"),
        F.max("timestamp").alias("last_bar"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def clear(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """`bars` without one symbol, or without any row."""
    return bars.where(F.lit(False)) if symbol is None else bars.where(F.col("symbol") != symbol)


def known_at(rows: DataFrame, knowledge: str, moment: str) -> DataFrame:
    """Rows whose knowledge time is at or before a moment; unknown times are not known."""
    return rows.where(F.col(knowledge) <= _moment(moment))
