"""Stored bar tables: what reads and upserts move, and what they leave."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import calibration, store
from tidebook.sources.layout import BarTable, buckets_for, ordered_reads


def executed(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def files(path) -> dict[str, float]:
    found = {}
    for folder, _, names in os.walk(path):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.select("symbol", "timestamp", "close", "seen", "interval").collect()), key=str)


@pytest.fixture
def days(spark):
    start = datetime(2024, 1, 1)
    data = [(s, start + timedelta(hours=6 * k), float(k + 1), 1, "6h") for s in ("hot", "b", "c") for k in range(360 if s == "hot" else 200)]
    return spark.createDataFrame(data, "symbol string, timestamp timestamp_ntz, close double, seen int, interval string")


@pytest.fixture
def table(spark, days, tmp_path):
    held = BarTable(spark, f"bars_{tmp_path.name}".replace("-", "_"), 4).save(days, str(tmp_path / "bars"))
    yield held
    spark.sql(f"DROP TABLE {held.name}")


def test_reads_by_session_need_neither_exchange_nor_sort(spark, table, days):
    s = Window.partitionBy("symbol", "day").orderBy("timestamp")
    with ordered_reads(spark):
        month = executed(table.read("2024-02").select("symbol", F.max("close").over(s)))
        daily = executed(table.read("2024-02").groupBy("symbol", "day").agg(F.sum("close")))
        years = executed(table.read().select("symbol", F.max("close").over(s)))
    assert "Exchange" not in month and "Sort" not in month.replace("SortAggregate", "") and "Exchange" not in daily
    assert "Exchange" not in years
    assert rows_of(table.read()) == rows_of(days)
    # one symbol's days are in several buckets
    hot = table.read().where("symbol = 'hot'").select(F.regexp_extract("_metadata.file_name", r"_(\d{5})\.", 1).alias("b")).distinct().count()
    assert hot == 4


def test_upsert_rewrites_the_months_that_it_touches(spark, table, days, tmp_path):
    before = files(tmp_path / "bars")
    fresh = spark.createDataFrame(
        [
            ("b", datetime(2024, 2, 1), -1.0, 2, "6h"),  # later: wins
            ("b", datetime(2024, 2, 1, 6), -2.0, 0, "6h"),  # stale: loses
            ("c", datetime(2024, 2, 1), -3.0, 1, "6h"),  # as old: wins
            ("new", datetime(2023, 12, 31), 7.0, 1, "6h"),  # a month of its own
            (None, datetime(2024, 2, 2), 8.0, 1, "6h"),
        ],
        days.schema,
    )
    want = rows_of(store.upsert_latest(days, fresh, "seen"))
    assert table.upsert(fresh, "seen") == ["2023-12", "2024-02"]
    after = files(tmp_path / "bars")
    old = {p: t for p, t in before.items() if "month=2024-02" not in p}
    assert old and all(after.get(p) == t for p, t in old.items())
    assert not any("month=2024-02" in p and p in before for p in after)
    assert rows_of(table.read()) == want
    # a bucket of a rewritten month is still one file
    with ordered_reads(spark):
        s = Window.partitionBy("symbol", "day").orderBy("timestamp")
        plan = executed(table.read("2024-02").select(F.max("close").over(s)))
    assert "Exchange" not in plan and "Sort" not in plan
    assert table.upsert(fresh, "seen") == ["2023-12", "2024-02"] and rows_of(table.read()) == want
    assert table.upsert(fresh.limit(0), "seen") == []


def test_refusals_leave_the_table_as_it_was(spark, table, days, tmp_path):
    before = files(tmp_path / "bars")
    with pytest.raises(ValueError, match="mixed intervals for b"):
        table.upsert(days.where("symbol = 'b'").limit(3).withColumn("interval", F.lit("1d")), "seen")
    assert files(tmp_path / "bars") == before
    with pytest.raises(ValueError, match="named day"):
        BarTable(spark, "clash", 2).save(days.withColumn("Day", F.lit(1)), str(tmp_path / "clash"))
    for name, n in (("a b", 1), ("x", 0)):
        with pytest.raises(ValueError):
            BarTable(spark, name, n)


def test_a_missing_time_has_a_month_of_its_own_and_empty_tables_read(spark, days, tmp_path):
    none = days.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    held = BarTable(spark, "with_nulls", 2).save(days.unionByName(none), str(tmp_path / "n"))
    assert held.read("none").count() == 1 and held.upsert(none, "seen") == ["none"] and held.read("none").count() == 1
    empty = BarTable(spark, "without_rows", 2).save(days.limit(0), str(tmp_path / "e"))
    assert empty.read().count() == 0 and buckets_for(days.limit(0), "timestamp") == 2
    assert empty.upsert(days, "seen") == ["2024-01", "2024-02", "2024-03"] and rows_of(empty.read()) == rows_of(days)
    for t in ("with_nulls", "without_rows"):
        spark.sql(f"DROP TABLE {t}")


def test_as_of_join_of_stored_tables_moves_neither(spark, table, days, tmp_path):
    picks = random.Random(4)
    at = [(picks.choice(["hot", "b", "c", "none", None]), datetime(2023, 12, 28) + timedelta(minutes=picks.randrange(150_000)), k) for k in range(500)]
    ticks = spark.createDataFrame(at, "symbol string, timestamp timestamp_ntz, id int")
    left = BarTable(spark, "ticks_as_of", 4).save(ticks, str(tmp_path / "ticks"))
    met = store.as_of_join(left.read(), table.read(), "symbol", "timestamp", "timestamp", "close", lanes="day").select("id", "close")
    plan = executed(met)
    stream = plan[: plan.index("BroadcastExchange")]
    assert "Union" in stream and "Exchange" not in stream
    bars = sorted(days.select("symbol", "timestamp", "close").collect())
    want = {k: next((b.close for b in reversed(bars) if b.symbol == s and b.timestamp <= t), None) for s, t, k in at}
    assert {x.id: x.close for x in met.collect()} == want
    spark.sql("DROP TABLE ticks_as_of")


@pytest.mark.parametrize("lanes", [1, 7, 4096])
def test_kolmogorov_in_lanes_with_ties_and_a_hot_model(spark, lanes):
    picks = random.Random(lanes)
    groups = {
        "hot": [picks.random() ** 2 for _ in range(3000)],
        "tied": [picks.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(500)],
        "edges": [-0.5, 1.5, 0.5],
        None: [0.3],
    }
    rows = spark.createDataFrame([(m, u) for m, us in groups.items() for u in us] + [("hot", None)], "model string, u double").repartition(5)
    found = {x.model: (x.ks, x.n) for x in calibration.kolmogorov(rows, ["model"], lanes).collect()}
    for model, us in groups.items():
        n = len(us)
        ks = max(max((i + 1) / n - u, u - i / n) for i, u in enumerate(sorted(us)))
        assert found[model] == (pytest.approx(ks, abs=1e-12), n)
    assert len(found) == len(groups)
