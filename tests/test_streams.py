"""Streams against the batch form of the same operator."""

import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidebook.operators import books
from tidebook.sources import journal, tables
from tidebook.streaming import gate, ohlcv, session, silence


def test_session_stream_equals_batch_over_a_restart(spark, sf, tmp_path):
    bars = (
        tables.hourly_bars(spark, sf)
        .where("timestamp < TIMESTAMP_NTZ '2024-01-06 00:00:00'")
        .select("symbol", F.col("timestamp").cast("timestamp").alias("bar_end"), "close")
        .cache()
    )
    cut = F.lit("2024-01-03 00:00:00").cast("timestamp")
    folder = tmp_path / "bars"
    stream = lambda: session.session_stream(spark.readStream.schema(bars.schema).parquet(str(folder)))
    for k, part in enumerate((bars.where(F.col("bar_end") < cut), bars)):  # the second repeats the first
        part.coalesce(1).write.mode("append").parquet(str(folder))
        ohlcv.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).where("event <> 'already_handled'").toPandas()
    want = session.session_batch(bars).toPandas()
    order = ["symbol", "bar_end", "event"]
    a, b = (x.sort_values(order).reset_index(drop=True)[sorted(x)] for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_gate_stream_equals_verdicts(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 10, 1), ("a", 12, 2), ("a", 11, 3), ("a", 12, 4), ("b", 5, 5), ("a", 13, 6), ("b", 4, 7)], "symbol string, s int, event_id long"
    ).select("symbol", F.timestamp_seconds("s").alias("ts"), "event_id", F.lit(1.0).alias("price"), F.lit(2.0).alias("volume"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = gate.gate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    ohlcv.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.event_id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.verdict for r in gate.verdicts(rows, ["event_id"]).collect()}
    assert got == want and sorted(got.values()).count("accepted") == 4


def ticks_of(rows, spark):
    return spark.createDataFrame(rows, "symbol string, s int, event_id long").select(
        "symbol", F.timestamp_seconds("s").alias("ts"), "event_id", F.col("s").cast("double").alias("price"), F.lit(2.0).alias("volume")
    )


def test_gate_stream_orders_a_whole_micro_batch(spark, tmp_path):
    """More rows of one symbol than an Arrow batch holds, in a file against their order of arrival."""
    n = 25_000
    rows = spark.range(n).select(
        F.lit("a").alias("symbol"), F.timestamp_seconds(n - F.col("id")).alias("ts"), (n - F.col("id")).alias("event_id"),
        F.lit(1.0).alias("price"), F.lit(1.0).alias("volume"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = gate.gate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    ohlcv.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).where("verdict = 'accepted'").count() == n


def test_ticks_without_a_time_are_refused_and_counted(spark, tmp_path):
    """Alone in a batch before and after there is a bar, and beside others; batch and stream say the same."""
    parts = [
        [("a", None, 1), ("b", 3, 2)], [("a", 10, 3), ("a", None, 4), ("a", 10, 5)], [("a", None, 6)], [("a", 3700, 7), ("c", None, 8)],
    ]
    schema = ticks_of(parts[1], spark).schema
    for part in parts:
        ticks_of(part, spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, build in (("bars", ohlcv.bars_stream), ("gate", gate.gate_stream)):
            stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            ohlcv.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    bars = spark.read.parquet(str(tmp_path / "bars")).collect()
    assert [(r.symbol, r.open, r.n_ticks, r.n_accepted, r.n_duplicates, r.n_untimed) for r in bars] == [("a", 10.0, 1, 2, 1, 3)]
    left = {r.symbol: (r.open, r.n_accepted, r.n_untimed) for r in ohlcv.open_bars(spark, str(tmp_path / "bars-checkpoint")).collect()}
    assert left == {"a": (3700.0, 2, 3), "b": (3.0, 1, 0), "c": (None, 0, 1)}
    got = {r.event_id: r.verdict for r in spark.read.parquet(str(tmp_path / "gate")).collect()}
    rows = ticks_of([r for part in parts for r in part], spark)
    assert got == {r.event_id: r.verdict for r in gate.verdicts(rows, ["event_id"]).collect()}
    assert sorted(k for k, v in got.items() if v == "untimed") == [1, 4, 6, 8]


def test_bars_stream_counts_what_it_refuses_and_flushes_what_is_open(spark, tmp_path):
    """Two batches: the slow symbol's ticks are far behind the fast one's clock and still make bars."""
    first = [("fast", 10, 1), ("fast", 7300, 2), ("slow", 5, 3), ("slow", 5, 4)]
    second = [("slow", 40, 5), ("slow", 20, 6), ("slow", 3700, 7), ("fast", 7301, 8)]
    schema = ticks_of(first, spark).schema
    for part in (first, second):
        ticks_of(part, spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ohlcv.bars_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        ohlcv.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    key = lambda df: sorted((r.symbol, r.bar_start.hour, r.open, r.high, r.low, r.close, r.volume, r.n_ticks, r.n_duplicates, r.n_out_of_order) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == [("fast", 0, 10.0, 10.0, 10.0, 10.0, 2.0, 1, 0, 0), ("slow", 0, 5.0, 40.0, 5.0, 40.0, 4.0, 2, 1, 1)]
    assert key(ohlcv.open_bars(spark, str(tmp_path / "checkpoint"))) == [
        ("fast", 2, 7300.0, 7301.0, 7300.0, 7301.0, 4.0, 2, 0, 0), ("slow", 1, 3700.0, 3700.0, 3700.0, 3700.0, 2.0, 1, 1, 1),
    ]


def test_state_streams_run_from_any_folder(sf, tmp_path):
    """A process that has the package on sys.path alone, in another working folder."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from tidebook.streaming import gate, ohlcv
ohlcv.run_available(gate.gate_stream(ohlcv.tick_stream(spark, {sf!r})), "out", "checkpoint")
print("rows", spark.read.parquet("out").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_staleness(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00")], "symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert gate.staleness(rows, "2024-01-01 00:05:00", 60).first().stale is True


def feed(rows, spark):
    return spark.createDataFrame(rows, "symbol string, ms long, event_id long").select("symbol", F.timestamp_millis("ms").alias("ts"), "event_id")


def test_a_feed_that_falls_silent_is_told_by_the_clock(spark, tmp_path):
    """No tick of its own is needed; one tick past the allowed age, not at it; a feed that never ticks counts from when it was asked for."""
    asked = spark.createDataFrame([("never", 0), ("late", 0), ("a", 0)], "symbol string, ms long").select("symbol", F.timestamp_millis("ms").alias("since"))
    parts = [
        [("a", 1000, 1), ("b", 5000, 2), ("clock", 11000, 3)],
        [("clock", 11001, 4), ("b", 9000, 5)],  # b's tick is behind the clock of the batch before
        [("clock", 11002, 6), ("b", 12000, 7), ("late", 12000, 8), ("b", None, 9)],
        [("a", 20000, 10), ("b", 40000, 11), ("b", 40000, 12), ("b", 39000, 13), ("a", 20500, 14), ("clock", 25000, 15)],
    ]
    told = []
    for part in parts:
        feed(part, spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ticks = spark.readStream.schema(feed(part, spark).schema).parquet(str(tmp_path / "in"))
        ohlcv.run_available(silence.silence_stream(ticks, 10, "0 seconds", asked), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        seconds = F.expr("unix_millis(last_tick)"), F.expr("unix_millis(moment)")
        rows = sorted(((r[0], r[2], r[3], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).select("symbol", "event", *seconds).collect() if r[0] != "never"), key=lambda x: (x[0], x[2]))
        told.append([r for r in rows if r not in sum(told, [])])
    assert told == [
        [("late", None, 10000, "silent")],
        [("a", 1000, 11000, "silent")],
        [("late", None, 12000, "resumed")],
        [
            ("a", 1000, 20000, "resumed"), ("a", 20500, 30500, "silent"), ("b", 12000, 22000, "silent"), ("b", 12000, 40000, "resumed"),
            ("clock", 11002, 21002, "silent"), ("clock", 11002, 25000, "resumed"), ("clock", 25000, 35000, "silent"), ("late", 12000, 22000, "silent"),
        ],
    ]
    never = spark.read.parquet(str(tmp_path / "out")).where("symbol = 'never'").collect()
    assert [(r.event, r.last_tick) for r in never] == [("silent", None)]


def test_silences_do_not_depend_on_how_ticks_are_cut_in_batches(spark, tmp_path):
    rows = [("ab"[k % 7 == 0], 1000 * (k * k % 97 + 40 * k), k) for k in range(60)]
    got = []
    for n in (1, 4):
        for k in range(n):
            feed(rows[k * 60 // n : (k + 1) * 60 // n], spark).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
            ticks = spark.readStream.schema(feed(rows, spark).schema).parquet(str(tmp_path / f"in{n}"))
            ohlcv.run_available(silence.silence_stream(ticks, 60, "200 seconds"), str(tmp_path / f"out{n}"), str(tmp_path / f"checkpoint{n}"))
        got.append(sorted(map(str, spark.read.parquet(str(tmp_path / f"out{n}")).collect())))
    assert got[0] == got[1] and len(got[0]) > 10


def test_a_journal_holds_each_line_once_though_its_stream_is_killed(spark, tmp_path):
    """Killed after the write of the second batch and before its commit; then one batch cannot be written."""
    line = lambda k: spark.createDataFrame([("bar", "a", f"2024-01-0{k} 00:00:00", float(k), k)], "event string, symbol string, as_of string, equity double, n int")
    path = str(tmp_path / "journal")

    def start(sink):
        stream = spark.readStream.schema(line(1).schema).parquet(str(tmp_path / "in"))
        run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()

    def dying(events, batch_id):
        journal.StreamJournal(path, order=("n",))(events, batch_id)
        raise RuntimeError("killed")

    line(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start(journal.StreamJournal(path, order=("n",)))
    line(2).union(line(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        start(dying)
    start(journal.StreamJournal(path, order=("n",)))
    entries, torn = journal.read_journal(spark, path)
    assert torn == 0 and sorted(r.equity for r in entries.collect()) == [1.0, 2.0, 3.0]
    state = books.journal_state(entries).first()
    assert (state.entries, state.last_as_of, state.last_equity) == (3, "2024-01-03 00:00:00", 3.0)
    # a file stands where the third batch would be a folder's parent; the stream lives, and the next batch is written
    broken, sink = journal.StreamJournal(str(tmp_path / "in-the-way" / "journal")), journal.StreamJournal(path)
    (tmp_path / "in-the-way").write_text("")
    line(4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start(broken)
    assert [k for k, _ in broken.problems] == [2] and journal.lost_batches(spark, path) == []
    line(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start(sink)
    assert not sink.problems and journal.lost_batches(spark, path) == [2]
    strict = journal.StreamJournal(broken.path, strict=True)
    line(6).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        start(strict)
    start(sink)
    assert sorted(r.equity for r in journal.read_journal(spark, path)[0].collect()) == [1.0, 2.0, 3.0, 5.0, 6.0]
