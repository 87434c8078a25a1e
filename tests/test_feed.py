"""Tables that land in files and come back as streams of bounded micro-batches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.plans import streams
from tidebook.plans.registry import ORACLE_SQL
from tidebook.sources import feed


def batches_of(stream, folder):
    """What each micro-batch of a stream holds, in the order in which they come."""
    got = []
    run = stream.writeStream.foreachBatch(lambda rows, _: got.append([r[0] for r in rows.collect()])).option("checkpointLocation", folder)
    run.trigger(availableNow=True).start().awaitTermination()
    return got


def test_a_landed_table_comes_in_bounded_batches_in_order(spark, tmp_path):
    """Against the order of the table, equal keys in one file, nulls last."""
    rows = spark.range(1000).select(F.when(F.col("id") != 7, F.floor((999 - F.col("id")) / 2)).alias("k"))
    feed.land(rows, F.col("k"), str(tmp_path / "in"), 100)
    got = batches_of(feed.landed(spark, rows.schema, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    assert 8 <= len(got) <= 10 and max(map(len, got)) <= 200
    assert sorted(x for b in got for x in b if x is not None) == sorted(r.k for r in rows.where("k IS NOT NULL").collect())
    key = lambda x: (x is None, x)
    assert all(max(a, key=key) < min(b, key=key) for a, b in zip(got, got[1:]) if None not in b) and None in got[-1]


def test_an_empty_table_lands_as_an_empty_stream(spark, tmp_path):
    rows = spark.range(0)
    feed.land(rows, F.col("id"), str(tmp_path / "in"))
    assert sum(map(len, batches_of(feed.landed(spark, rows.schema, str(tmp_path / "in")), str(tmp_path / "checkpoint")))) == 0


def check_in_many_batches(spark, sf, monkeypatch, name):
    """The query over a feed of many small files equals its SQL over the table."""
    monkeypatch.setattr(feed, "FILE_ROWS", 250)
    seen = []
    landed = feed.landed
    monkeypatch.setattr(feed, "landed", lambda spark, schema, path: seen.append(spark.read.parquet(path).inputFiles()) or landed(spark, schema, path))
    got = sorted(str(tuple(r)) for r in getattr(streams, name)(spark, sf).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = sorted(str(tuple(r)) for r in con.sql(ORACLE_SQL[name]).fetchall())
    assert got == want and len(got) >= 5
    assert seen and all(len(files) > 2 for files in seen)


@pytest.mark.parametrize("name", ["stream_ohlcv", "stream_flush"])
def test_bars_of_a_landed_feed_equal_their_sql(spark, sf, monkeypatch, name):
    check_in_many_batches(spark, sf, monkeypatch, name)


def test_verdicts_of_a_landed_feed_equal_their_sql(spark, sf, monkeypatch):
    check_in_many_batches(spark, sf, monkeypatch, "stream_gate")


def test_silences_of_a_landed_feed_equal_their_sql(spark, sf, monkeypatch):
    """Ticks come later than the clock is behind; none is lost where batches end."""
    check_in_many_batches(spark, sf, monkeypatch, "stream_silences")
