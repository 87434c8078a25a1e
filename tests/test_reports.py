from pyspark.sql import functions as F

from tidebook.operators import books, health
from tidebook.plans import dashboard, reports


def test_health_fails_closed():
    assert {c.status for c in health.checks(health.SessionState())} == {"fail"}
    good = health.SessionState(True, "matched", 5.0, 60.0, True, True, 1e6, 0.01, 0.15, True, True, 12, 5)
    assert health.may_open_positions(good)
    assert not health.may_open_positions(health.SessionState(**{**good.__dict__, "equity": float("nan")}))
    assert not health.may_open_positions(health.SessionState(**{**good.__dict__, "pending": 51}))


def test_reports(spark):
    local = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 5.0)], "symbol string, quantity double, average_price double")
    venue = spark.createDataFrame([("a", 1.0, 10.0), ("b", 3.0, 5.0), ("c", 0.0, 1.0)], "symbol string, quantity double, average_price double")
    text = reports.reconciliation_report("mismatched", books.reconcile_positions(local, venue))
    assert "kind=quantity_mismatch" in text and "symbol=c" not in text
    fills = spark.createDataFrame(
        [("bar", "a", "2024-01-01", "buy", 2.0, 10.0, 0.1, "o1"), ("bar", "a", "2024-01-02", "buy", 2.0, 20.0, 0.1, "o2"), ("halted", "a", "2024-01-03", None, None, None, None, None)],
        "event string, symbol string, as_of string, action string, filled double, fill_price double, fees double, order_id string",
    )
    ok, problems = books.rebuild_verdict(fills, 0, 100.0)
    text = reports.rebuild_report(ok, problems, books.rebuilt_cash(fills, 100.0), books.rebuild_positions(fills))
    assert "consistent" in text and "cash: 39.80" in text and "average_price=15.0" in text
    events = spark.createDataFrame([("bar",), ("bar",), ("settled",)], "event string")
    assert "must not open positions" in reports.session_report(events, health.SessionState())


def test_dashboard_is_self_contained_and_bounded(spark, tmp_path):
    curve = spark.range(5_000).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"), (F.col("id") + 1.0).alias("equity"))
    decisions = spark.createDataFrame([("buy", None), ("no_trade", "</script><b>")], "action string, reason string")
    data = dashboard.payload(curve, decisions, points=100)
    assert len(data["equity"]) == 100 and data["equity"][-1]["equity"] == 5000.0
    dashboard.write_dashboard(str(tmp_path / "d.html"), data, "a <b> & c")
    html = (tmp_path / "d.html").read_text()
    assert html.count("</script>") == 2 and "http" not in html.replace("http://www.w3.org/2000/svg", "")
    assert dashboard.payload(curve.limit(0), decisions)["equity"] == []
