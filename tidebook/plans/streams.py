"""Streaming queries, run to the end of what is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import books
from tidebook.plans import trading
from tidebook.plans.registry import ORACLE_SQL, TICKS, query, r, rounded
from tidebook.runtime import shared_dir
from tidebook.sources import feed, journal, tables
from tidebook.streaming import gate, ohlcv, session, silence


#: Ticks as they arrive: each six times, those of every eleventh event late, and the fourth of every ninth event without a time, in SQL.
COPIES = 6
ARRIVING = f"""{TICKS}, ar AS (SELECT symbol, CASE WHEN k = 3 AND event_id % 9 = 0 THEN NULL ELSE ts END AS ts, price, volume,
        (event_id + CASE WHEN event_id % 11 = 0 THEN 7 ELSE 0 END) * 100 + CASE WHEN event_id % 11 = 0 THEN 50 ELSE 0 END + k AS arrival
        FROM ticks, (SELECT unnest(range({COPIES})) AS k)),
    v AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ar),
    j AS (SELECT *, CASE WHEN ts IS NULL THEN 'untimed' WHEN ts < seen THEN 'out_of_order' WHEN ts = seen THEN 'duplicate' ELSE 'accepted' END AS verdict FROM v)"""


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of late, repeated and untimed ticks; event_id is the order of arrival, which is not that of the table.

    Events land in files by arrival, so a micro-batch holds one file's ticks however long the table is.
    """
    late = F.col("event_id") % 11 == 0
    base = (F.col("event_id") + F.when(late, 7).otherwise(0)) * 100 + F.when(late, 50).otherwise(0)
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    events = tables.table(spark, sf_dir, "events").where("value > 0").select("event_id", "ts", "event_type", "value", "props")
    feed.land(events, base, path)
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    untimed = (F.col("k") == 3) & (F.col("event_id") % 9 == 0)
    told = ohlcv.ticks_of(feed.landed(spark, events.schema, path)).withColumn("k", copies).withColumn("ts", F.when(~untimed, F.col("ts")))
    return told.withColumn("event_id", base + F.col("k")).drop("k")


def _run(spark: SparkSession, stream: DataFrame) -> tuple[DataFrame, str]:
    """What the stream wrote, and its checkpoint."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ohlcv.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), f"{folder}/checkpoint"


FEED_BARS = f"""WITH {ARRIVING}, good AS (SELECT *, date_trunc('hour', ts) AS bar_start FROM j WHERE verdict = 'accepted'),
    bars AS (SELECT symbol, bar_start, first(price ORDER BY arrival) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY arrival) AS close,
                    sum(volume) AS volume, count(*) AS n_ticks FROM good GROUP BY 1, 2),
    ends AS (SELECT symbol, max(bar_start) AS final FROM bars GROUP BY 1)"""
PRICES = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))


@query("stream_ohlcv", f"""{FEED_BARS} SELECT symbol, bar_start, {PRICES}, n_ticks FROM bars JOIN ends USING (symbol) WHERE bar_start < final""")
def stream_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that accepted ticks of a later bucket close; each symbol's open bar at the end is not among them."""
    bars, _ = _run(spark, ohlcv.bars_stream(arriving(spark, sf_dir)))
    start = F.col("bar_start").cast("timestamp_ntz")
    return rounded(bars.withColumn("bar_start", start).select("symbol", "bar_start", "open", "high", "low", "close", "volume", "n_ticks"))


@query(
    "stream_flush",
    f"""{FEED_BARS}, c AS (SELECT symbol, count(*) FILTER (verdict = 'accepted') AS n_accepted, count(*) FILTER (verdict = 'duplicate') AS n_duplicates,
            count(*) FILTER (verdict = 'out_of_order') AS n_out_of_order, count(*) FILTER (verdict = 'untimed') AS n_untimed FROM j GROUP BY 1)
        SELECT symbol, bar_start, {PRICES}, n_ticks, n_accepted, n_duplicates, n_out_of_order, n_untimed FROM bars JOIN ends USING (symbol) JOIN c USING (symbol)
        WHERE bar_start = final""",
)
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that the end of a session flushes, read from the stream's state, with all that the gate has counted."""
    _, checkpoint = _run(spark, ohlcv.bars_stream(arriving(spark, sf_dir)))
    rest = ohlcv.open_bars(spark, checkpoint)
    return rounded(rest.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz")))


@query("stream_gate", f"""WITH {ARRIVING} SELECT symbol, verdict, count(*) AS n FROM j GROUP BY 1, 2""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a state per symbol on late and repeated ticks."""
    out, _ = _run(spark, gate.gate_stream(arriving(spark, sf_dir)))
    return out.groupBy("symbol", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_foreign",
    f"""WITH {TICKS} SELECT symbol, symbol IN ('purchase', 'view') AS asked, count(*) AS n, {r("sum(price)", "total", 4)} FROM ticks GROUP BY 1, 2""",
)
def stream_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that asked for two symbols: its ticks, and those of symbols that it did not ask for."""
    own, other = gate.foreign(tables.ticks(spark, sf_dir), ["purchase", "view"])
    rows = own.withColumn("asked", F.lit(True)).unionByName(other.withColumn("asked", F.lit(False)))
    return rounded(rows.groupBy("symbol", "asked").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")), 4)


SILENT, BEHIND = 1200, 600


@query(
    "stream_silences",
    f"""WITH {ARRIVING}, a AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY arrival) AS before,
            lead(ts) OVER (PARTITION BY symbol ORDER BY arrival) AS after FROM j WHERE verdict = 'accepted'),
        clock AS (SELECT max(epoch_ms(ts)) - {BEHIND} * 1000 AS mark FROM ar),
        gaps AS (SELECT * FROM a WHERE epoch_us(ts) - epoch_us(before) > {SILENT} * 1000000)
        SELECT symbol, 'silent' AS event, before AS last_tick, before + INTERVAL {SILENT} SECOND AS moment FROM gaps
        UNION ALL SELECT symbol, 'resumed', before, ts FROM gaps
        UNION ALL SELECT symbol, 'silent', ts, ts + INTERVAL {SILENT} SECOND FROM a, clock
        WHERE after IS NULL AND epoch_us(ts) + {SILENT} * 1000000 < mark * 1000""",
)
def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of more than twenty minutes between accepted ticks, and those that last when the clock, ten minutes behind, stops.

    The gate judges by arrival; what it accepted lands again by time, which keeps each
    symbol's order, so that no tick is behind the clock of an earlier micro-batch.
    """
    told, _ = _run(spark, gate.gate_stream(arriving(spark, sf_dir)))
    accepted = told.where("verdict = 'accepted'").select("symbol", "ts", "event_id")
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    feed.land(accepted, F.col("ts"), path)
    out, _ = _run(spark, silence.silence_stream(feed.landed(spark, accepted.schema, path), SILENT, f"{BEHIND} seconds"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_tick", "moment")})


@query("stream_journal", ORACLE_SQL["journal_state"])
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a journal that a stream wrote, every batch of which came twice, as after a crash before its commit."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = trading.journal(spark, sf_dir)
    lines.repartitionByRange(4, "line").write.parquet(f"{folder}/in")
    sink = journal.StreamJournal(f"{folder}/journal", order=("line",), strict=True)

    def twice(events: DataFrame, batch_id: int) -> None:
        sink(events, batch_id)
        sink(events, batch_id)

    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    run = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    entries, _ = journal.read_journal(spark, sink.path)
    # files come in any order here, so the time of a line says which is the last
    return books.journal_state(entries.withColumn("line", F.col("as_of")))


@query("session_events")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper session over hourly bars: refits, fused predictions, rulings, fills and settlements after five bars; a fold per symbol."""
    bars = tables.hourly_bars(spark, sf_dir).select(
        "symbol", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("bar_end"), "close", "volume"
    )
    out = session.session_batch(bars)
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bar_end", "settled_bar")}))
