"""Bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.runtime import ship_package
from tidebook.streaming.gate import in_order, judged, micros

TICK_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Tick files as a stream; times become instants of the session's zone, as watermarks need them."""
    return ticks_of(spark.readStream.schema(TICK_SCHEMA).option("pathGlobFilter", pattern).parquet(folder))


def ticks_of(raw: DataFrame) -> DataFrame:
    """Rows of events as ticks, in a table or a stream."""
    return raw.where("value > 0").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        "event_id",
    )


BARS = (
    "symbol string, bar_start timestamp, bar_end timestamp, open double, high double, low double, close double, volume double, "
    "n_ticks long, n_accepted long, n_duplicates long, n_out_of_order long, n_untimed long"
)
#: The open bar of a symbol: where it starts, its ticks, and what the gate has counted.
HELD = "seen long, bucket long, open double, high double, low double, close double, volume double, n_ticks long, accepted long, duplicates long, out_of_order long, untimed long"


class Bars(StatefulProcessor):
    """Gate and open bar of each symbol; a bar is closed by an accepted tick of a later bucket."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, ["ts", "event_id", "price", "volume"])
        seen, *bar, _, _, _, _ = before = self.held.get() if self.held.exists() else (None, None, *[None] * 5, 0, 0, 0, 0, 0)
        codes, seen = judged(micros(batch.ts), seen)
        good = batch[codes == 0]
        bucket = micros(good.ts) // self.width * self.width
        # volumes that are absent add nothing, as in a sum of a table
        parts = good.assign(volume=good.volume.fillna(0.0)).groupby(bucket, sort=True).agg(
            open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"),
            volume=("volume", "sum"), n_ticks=("price", "size"),
        ).reset_index(names="bucket")
        if bar[0] is not None and len(parts) and parts.bucket[0] == bar[0]:
            _, opened, high, low, _, volume, n = bar
            parts.loc[0, ["open", "high", "low"]] = opened, max(high, parts.high[0]), min(low, parts.low[0])
            parts.loc[0, "volume"] += volume
            parts.loc[0, "n_ticks"] += n
        elif bar[0] is not None:
            parts = pd.concat([pd.DataFrame([bar], columns=parts.columns), parts], ignore_index=True)
        # the counters of a bar are those at the end of the batch that closed it
        counts = tuple(n + int((codes == k).sum()) for k, n in enumerate(before[-4:]))
        if not len(parts):  # no tick with a time yet: only counters are held
            self.held.update((*before[:-4], *counts))
            return
        last = parts.iloc[-1]
        self.held.update((seen, int(last.bucket), *map(float, last[1:6]), int(last.n_ticks), *counts))
        done = parts.iloc[:-1]
        yield pd.DataFrame(
            {
                "symbol": key[0], "bar_start": pd.to_datetime(done.bucket, unit="us"), "bar_end": pd.to_datetime(done.bucket + self.width, unit="us"),
                **{c: done[c] for c in ("open", "high", "low", "close", "volume", "n_ticks")},
                "n_accepted": counts[0], "n_duplicates": counts[1], "n_out_of_order": counts[2], "n_untimed": counts[3],
            }
        )

    def close(self) -> None:
        pass


def bars_stream(ticks: DataFrame, seconds: int = 3600) -> DataFrame:
    """Closed bars of a stream of ticks behind the gate, per symbol, with the gate's counters so far.

    Ticks are judged and gathered in one state per symbol, so that a slow symbol loses
    nothing to the clock of a fast one: late and repeated ticks are refused by their
    own symbol's latest tick alone, and counted, as are ticks without a time.
    """
    ship_package()
    return ticks.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Bars(seconds * 1_000_000), outputStructType=BARS, outputMode="append", timeMode="None"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there to a Parquet sink and stops; a second run goes on after the first.

    State is kept in RocksDB, which states with several columns need and which spills
    beyond memory.
    """
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        _run_available(stream, path, checkpoint)
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def _run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def open_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open bar of each symbol with the gate's counters, read from the state of a stopped stream: its flush.

    A symbol that sent no tick with a time has no bar, only counters.
    """
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("key.*", "value.*")
    return held.select(
        F.col(held.columns[0]).alias("symbol"),
        F.timestamp_micros("bucket").alias("bar_start"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "n_ticks",
        F.col("accepted").alias("n_accepted"),
        F.col("duplicates").alias("n_duplicates"),
        F.col("out_of_order").alias("n_out_of_order"),
        F.col("untimed").alias("n_untimed"),
    )
