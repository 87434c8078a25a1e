"""Kernels, invariants and operators of the engine."""

import itertools
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook import schema
from tidebook.config import RiskLimits, Secret, Settings
from tidebook.functions import features as f
from tidebook.functions import filters, special
from tidebook.operators import books, calendar, provenance, quality, series, store, trading
from tidebook.operators.calendar import TradingCalendar
from tidebook.operators.life_cycle import estimate_regime
from tidebook.operators.walk_forward import WalkForward
from tidebook.sources import bars as bar_files
from tidebook.sources import broker, bundles, frames, journal, synthetic, tables, vendors


# --- numbers ---------------------------------------------------------------------------------------------------------
def test_student_t_against_closed_forms():
    x = np.linspace(-30, 30, 101)
    assert np.abs(special.t_cdf(x, 0, 1, 1.0) - (0.5 + np.arctan(x) / np.pi)).max() < 1e-14
    assert np.abs(special.t_cdf(x, 0, 1, 2.0) - (0.5 + x / (2 * np.sqrt(2 + x * x)))).max() < 1e-14
    m = (np.array([0.3, 0.7]), np.array([-0.1, 0.2]), np.array([0.5, 1.0]), np.array([4.0, 30.0]))
    for p in (0.001, 0.05, 0.5, 0.99):
        assert special.mixture_cdf(special.mixture_quantile(p, m), m) == pytest.approx(p, abs=1e-12)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329) and special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)


def test_regime_filter_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(11)
    p = filters.RegimeParameters(0.0004, 0.0006, 0.94, 1.4e-4, 0.5, 500)
    r = rng.normal(0, 0.012, 7)
    loc, scale, df = p.emission()
    pi = np.array(filters.STATIONARY)
    a = p.persistence * np.eye(3) + (1 - p.persistence) * pi[None, :]
    density = np.exp(special.t_logpdf(r[:, None], loc, scale, df))
    total, last = 0.0, np.zeros(3)
    start = pi @ a
    for path in itertools.product(range(3), repeat=7):
        weight = start[path[0]] * density[0, path[0]]
        for k in range(1, 7):
            weight *= a[path[k - 1], path[k]] * density[k, path[k]]
        total += weight
        last[path[-1]] += weight
    found = filters.RegimeFilter(p)
    for v in r:
        found.observe(v)
    assert np.abs(found.belief - last / total).max() < 1e-13 and found.log_likelihood == pytest.approx(math.log(total), abs=1e-12)
    with pytest.raises(ValueError, match="no regime"):
        filters.RegimeFilter(p).observe(1e200)
    aleatoric, state, parameter = found.split(5)
    parts, epistemic = found.predictive(5)
    w, m, s, d = map(np.array, zip(*parts, strict=True))
    variance = (w * (s**2 * d / (d - 2) + (m - (w * m).sum()) ** 2)).sum()
    assert aleatoric + state + parameter == pytest.approx(variance, rel=1e-12) and epistemic == pytest.approx(state + parameter)


def test_variance_filter_finds_the_scale_and_ages_on_gaps():
    rng = np.random.default_rng(1)
    v = filters.VarianceFilter()
    for x in rng.normal(0, 0.02, 3000):
        v.observe(x)
    assert math.sqrt(v.noise_variance()) == pytest.approx(0.02, rel=0.1) and v.expected_discount() > 0.95
    held, seen = v.effective_n(), v.n_seen
    v.observe(None)
    assert v.effective_n() < held and (v.n_seen, v.n_skipped) == (seen, 1)


def test_reliability_prefers_the_better_model_and_refuses_nonsense():
    r = filters.Reliability()
    for _ in range(200):
        r.score({"good": 1.0, "bad": 0.5})
    assert r.weights()["good"] > 0.99 and sum(r.weights().values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        r.score({"good": math.nan})
    with pytest.raises(ValueError):
        r.score({"good": -math.inf, "bad": -math.inf})


def test_book_averages_in_only():
    b = filters.Book(1000.0)
    b.apply("x", "buy", 2, 100, 1).apply("x", "buy", 2, 110, 1)
    assert b.positions["x"] == (4, 105)
    b.apply("x", "sell", 1, 200, 0)
    assert b.positions["x"] == (3, 105)
    b.apply("x", "sell", 5, 90, 0)
    assert b.positions["x"] == (-2, 90)
    b.apply("x", "buy", 2, 80, 0)
    assert "x" not in b.positions and b.cash == pytest.approx(1000 - 200 - 220 - 2 + 200 + 450 - 160)


# --- features --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def bars(spark, sf):
    return tables.hourly_bars(spark, sf).cache()


def rows_of(df):
    return {(r.symbol, r.timestamp): tuple(r)[2:] for r in df.collect()}


def test_features_do_not_see_the_future(bars):
    """Bars after a cut are multiplied; values up to the cut stay the same bit by bit."""
    cut = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    factor = F.when(F.col("timestamp") > cut, F.when(F.minute("timestamp") % 2 == 0, 4.0).otherwise(0.25) * 3).otherwise(1.0)
    poisoned = bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close", "volume")})
    found = f.default_set()
    a = rows_of(series.feature_walk(bars, found).where(F.col("timestamp") <= cut))
    b = rows_of(series.feature_walk(poisoned, found).where(F.col("timestamp") <= cut))
    assert a == b and len(a) > 300


def test_chunks_change_nothing(bars):
    found = f.default_set()
    whole, cut = rows_of(series.feature_walk(bars, found)), rows_of(series.feature_walk(bars.repartition(7), found, chunk=20))
    assert whole.keys() == cut.keys()
    for k, row in whole.items():
        for x, y in zip(row, cut[k], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9))


def test_warm_up_is_null_and_names_are_unique(bars):
    walked = series.feature_walk(bars, f.minimal_set())
    assert walked.where("n_bars < 22 AND momentum_20_1 IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        series.feature_walk(bars, [f.log_return(1), f.log_return(1)])
    with pytest.raises(KeyError):
        f.subset(f.minimal_set(), ["nope"])
    with pytest.raises(ValueError):
        f.moving_average_spread(26, 12)
    assert f.lookback(f.default_set()) == 140
    # fixed values: names of the standard set
    assert [x.name for x in f.default_set()] == [
        "log_return_1", "log_return_5", "momentum_60_5", "momentum_120_20", "close_to_sma_50", "ema_spread_12_26", "trend_slope_60",
        "trend_quality_60", "price_zscore_20", "rsi_14", "drawdown_120", "volatility_20", "ewma_volatility_20", "parkinson_volatility_20",
        "downside_volatility_60", "volatility_ratio_10_120", "atr_pct_14", "relative_volume_20", "volume_zscore_60", "turnover_median_20", "amihud_20",
    ]


def test_labels_stop_at_the_horizon(bars):
    n = bars.groupBy("symbol").count().agg(F.sum(F.col("count") - 5)).first()[0]
    labels = series.forward_labels(bars, 5)
    assert labels.count() == n and labels.where("mae > 0 OR mfe < 0 OR realised_at <= as_of").count() == 0


def test_labels_over_chunks_are_those_of_whole_series(bars):
    """Chunks shorter and longer than a series; the bars that a chunk looks ahead to lie in the next one."""
    found = f.minimal_set()
    plain = lambda df: sorted(map(str, df.select([F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]).collect()))
    labels, rows = plain(series.forward_labels(bars, 5)), plain(series.training_set(bars, found, 5))
    for chunk in (7, 40, 10_000):
        spread = bars.repartition(7)
        assert plain(series.forward_labels(spread, 5, chunk=chunk)) == labels and plain(series.training_set(spread, found, 5, chunk=chunk)) == rows
    assert len(labels) > len(rows) > 300


# --- store, calendars, quality -------------------------------------------------------------------------------------------
def test_store_errors_and_empty_reads(spark, bars):
    assert store.history(bars, "1990-01-01 00:00:00").count() == 0 and store.history(bars, "2030-01-01 00:00:00", count=0).count() == 0
    with pytest.raises(ValueError):
        store.history(bars, "2030-01-01 00:00:00", count=-1)
    one = bars.limit(1).withColumn("arrival", F.lit(1))
    mixed = one.withColumn("interval", F.lit("1d")).withColumn("timestamp", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="mixed intervals"):
        store.upsert_latest(one, mixed, "arrival").collect()
    symbol = bars.first().symbol
    assert store.clear(bars, symbol).where(F.col("symbol") == symbol).count() == 0 and store.clear(bars).count() == 0


def test_calendar_fails_closed(spark):
    exchange = TradingCalendar.exchange()
    days = spark.createDataFrame([("2027-01-04",)], "d string").select(F.col("d").cast("date").alias("day"))
    with pytest.raises(Exception, match="does not cover"):
        days.select(exchange.trading_day(F.col("day"))).collect()
    assert days.select(exchange.trading_day(F.col("day"), strict=False)).first()[0] is True
    shut = TradingCalendar(frozenset(date(2026, 1, 1) + timedelta(d) for d in range(200)), years=frozenset({2026}))
    assert calendar.trading_days(spark, shut, "2026-01-01", 3).collect()[0].day == date(2026, 7, 20)
    assert calendar.trading_days(spark, shut, "2026-01-01", 3).count() == 3
    assert calendar.trading_days(spark, exchange, "2026-11-07", 2).collect()[0].day.isoformat() == "2026-11-08"


def test_sessions_from_any_day(spark):
    exchange = TradingCalendar.exchange()
    rows = spark.createDataFrame([("2025-10-20",), ("2026-11-07",), ("2026-12-24",), (None,)], "d string").select(F.col("d").cast("date").alias("day"), F.lit(1).alias("x"))
    found = {r.day and r.day.isoformat(): r.sessions and [d.isoformat() for d in r.sessions] for r in calendar.sessions_from(rows, "day", exchange, 3).collect()}
    assert found == {
        "2025-10-20": ["2025-10-20", "2025-10-21", "2025-10-23"],  # a special session on a holiday, then a holiday
        "2026-11-07": ["2026-11-08", "2026-11-09", "2026-11-11"],  # a special session on a Sunday
        "2026-12-24": ["2026-12-24", "2026-12-28", "2026-12-29"],
        None: None,
    }
    assert calendar.sessions_from(rows.limit(0), "day", exchange, 3).columns == ["day", "x", "sessions"]
    shut = TradingCalendar(frozenset(date(2026, 1, 1) + timedelta(d) for d in range(200)), years=frozenset({2026}))
    assert calendar.sessions_from(rows.where("day = '2026-11-07'"), "day", shut, 1).first().sessions == [date(2026, 11, 9)]
    early = spark.createDataFrame([(date(2026, 1, 2),)], "day date")
    assert calendar.sessions_from(early, "day", shut, 1).first().sessions == [date(2026, 7, 20)]
    wide = spark.createDataFrame([(date(1, 1, 1),), (date(9999, 1, 1),)], "day date")
    with pytest.raises(ValueError, match="span"):
        calendar.sessions_from(wide, "day", exchange, 1)
    with pytest.raises(ValueError):
        calendar.sessions_from(rows, "day", exchange, 0)


def test_calendar_file(spark, tmp_path):
    (tmp_path / "days.txt").write_text("2030-01-01 # new year\n\n# nothing\n2030-12-25\n")
    found = calendar.load_calendar(spark, str(tmp_path / "days.txt"), [2030], ["me"])
    assert len(found.holidays) == 2
    with pytest.raises(ValueError):
        calendar.load_calendar(spark, str(tmp_path / "days.txt"), [], ["me"])


def test_quality_report_of_a_split(spark):
    bars = synthetic.simulate(spark.createDataFrame([("s",)], "symbol string"), 120, seed=5)
    after = F.col("timestamp") > F.lit("2020-04-01 00:00:00").cast("timestamp_ntz")
    split = bars.withColumns({c: F.when(after, F.col(c) / 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    found = quality.report(split.withColumn("arrival", F.col("timestamp")), "arrival")
    assert [r.check for r in found.collect()] == ["suspected_split"]
    assert quality.summary(found, bars).first().is_usable is False
    assert quality.report(bars.withColumn("arrival", F.col("timestamp")), "arrival").count() == 0


# --- sources -----------------------------------------------------------------------------------------------------------
def test_bar_files(spark, bars, tmp_path):
    bar_files.write_bars(bars, str(tmp_path / "csv"))
    ok, bad = bar_files.read_bars(spark, str(tmp_path / "csv"))
    assert ok.count() == bars.count() and bad.count() == 0
    (tmp_path / "bad.csv").write_text("interval,symbol,timestamp,open,high,low,close,volume\n1d,a,2024-01-01 00:00:00,1,2,1,2,5\n1d,a,x,1,2,1,2,5\n1d,a,2024-01-02 00:00:00,1,2,3,2,5\n\n")
    ok, bad = bar_files.read_bars(spark, str(tmp_path / "bad.csv"))
    assert ok.count() == 1 and bad.count() == 2
    assert sorted((x._line, x._place.endswith(f"/bad.csv:{x._line}")) for x in bad.collect()) == [(3, True), (4, True)]
    (tmp_path / "short.csv").write_text("symbol,timestamp\na,b\n")
    with pytest.raises(ValueError, match="open"):
        bar_files.read_bars(spark, str(tmp_path / "short.csv"))
    bar_files.save_store(bars, str(tmp_path / "store"))
    assert bar_files.load_store(spark, str(tmp_path / "store")).exceptAll(bars.select(*bar_files.COLUMNS)).count() == 0


def test_rejects_name_their_line_over_many_splits(spark, tmp_path):
    """Files in splits of a few hundred bytes; blank lines count, wrong arity and another header are refused."""
    names = "symbol,timestamp,open,high,low,close,volume,interval"
    (tmp_path / "in").mkdir()
    wrong = {}
    for name in ("a", "b"):
        lines = [names]
        for k in range(2, 400):
            row = f"s{k % 3},2024-01-{1 + k % 28:02d} {k % 24:02d}:00:00,1.5,2,1,1.75,{k},1d"
            lines.append("" if k % 41 == 0 else row + ",7" if k % 43 == 0 else row.replace("1.5", "9") if k % 47 == 0 else row.replace("2024", "then") if k % 53 == 0 else row)
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(lines) + "\n")
        wrong |= {(name, k): lines[k - 1] for k in range(2, 400) if k % 41 and (k % 43 == 0 or k % 47 == 0 or k % 53 == 0)}
    (tmp_path / "in" / "c.csv").write_text("timestamp,symbol,open,high,low,close,volume,interval\n2024-01-01 00:00:00,s,1,2,1,1,5,1d\n")
    wrong["c", 2] = "2024-01-01 00:00:00,s,1,2,1,1,5,1d"
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "700")
    try:
        ok, bad = bar_files.read_bars(spark, str(tmp_path / "in"))
        lines = bar_files.numbered_lines(spark, str(tmp_path / "in"))
        splits = spark.read.text(str(tmp_path / "in")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert splits > 30 and lines.groupBy("path").agg(F.max("line").alias("n")).agg(F.max("n")).first()[0] == 399
        found = {(x._path.rsplit("/", 1)[1][0], x._line): x._text for x in bad.collect()}
        assert found == wrong
        assert ok.count() == 2 * 398 - 2 * len([k for k in range(2, 400) if k % 41 == 0]) - (len(wrong) - 1)
    finally:
        spark.conf.set(size, before)


def test_frames(spark):
    full = bytearray(184)
    full[0:4], full[4:8], full[16:20] = (408065).to_bytes(4, "big"), (250_000).to_bytes(4, "big"), (900).to_bytes(4, "big")
    full[64:68], full[68:72], full[124:128], full[128:132] = (5).to_bytes(4, "big"), (249_900).to_bytes(4, "big"), (7).to_bytes(4, "big"), (250_100).to_bytes(4, "big")
    short = (3).to_bytes(4, "big") + (-25).to_bytes(4, "big", signed=True)
    data = (2).to_bytes(2, "big") + b"".join(len(p).to_bytes(2, "big") + bytes(p) for p in (full, short))
    rows = frames.decode(frames.packets(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"\0"))], "id int, frame binary"))).collect()
    assert [(r.mode, r.segment, r.last_price) for r in rows] == [("full", 1, 2500.0), ("ltp", 3, -2.5e-06)]
    assert (rows[0].bid, rows[0].ask, rows[0].volume, rows[0].bid_quantity) == (2499.0, 2501.0, 900, 5)
    with pytest.raises(ValueError, match="cut off"):
        list(frames.split_frame(data[:-1]))


def test_vendor_plumbing(spark):
    from datetime import date

    assert len(vendors.windows(date(2024, 1, 1), date(2024, 12, 31), "1d")) == 3
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise vendors.TransientError("busy")
        return "ok"

    pauses = []
    assert vendors.Retrying(sleep=pauses.append)(flaky) == "ok" and pauses == [0.5, 1.0]
    source = vendors.SyntheticSource(spark)
    assert source.fetch_bars("a", date(2024, 1, 1), date(2024, 1, 31)).where(schema.bar_is_valid()).count() == 23
    with pytest.raises(ValueError):
        vendors.check_window(source, date(2024, 2, 1), date(2024, 1, 1), "1d")
    assert vendors.translate_status(429) is vendors.TransientError and vendors.translate_status(200) is None


def test_broker_client():
    def transport(method, url, headers, query):
        return (200, {"status": "SUCCESS", "payload": 7}) if "quote" in url else (404, None)

    client = broker.ReadClient(transport, "http://x", Secret("tok-7"))
    assert client.call("/quote/a") == 7 and "tok-7" not in repr(client)
    with pytest.raises(LookupError):
        client.call("/historical/a")
    with pytest.raises(PermissionError):
        client.call("/orders")
    with pytest.raises(ValueError):
        broker.order_params("a", "buy", 0.4)
    assert broker.order_params("a", "buy", 2.6)["quantity"] == "3"


def test_journals_and_bundles(spark, tmp_path):
    sink = journal.JournalSink(str(tmp_path / "j.jsonl"))
    sink.record(event="bar", symbol="a", as_of="2024-01-01 00:00:00", equity=5.0)
    with open(tmp_path / "j.jsonl", "a") as torn:
        torn.write('{"event": "bar", "sym')
    entries, broken = journal.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert entries.count() == 1 and broken == 1
    assert books.rebuild_verdict(entries, broken, 5.0) == (True, []) and not books.rebuild_verdict(entries, broken, 100.0)[0] and not books.rebuild_verdict(entries, 2, None)[0]
    lost = journal.JournalSink(str(tmp_path / "none" / "j"))
    lost.record(event="bar")
    assert lost.problems
    # a halt after the last bar moves the mark of a restart; the last equity is that of the last line
    sink.problems.clear()
    for event, hour, equity in (("bar", 11, 7.0), ("bar", 10, 6.0), ("halted", 12, None)):
        journal.JournalSink(str(tmp_path / "k.jsonl")).record(event=event, symbol="a", as_of=f"2024-01-01 {hour}:00:00", equity=equity, filled=-1.0)
    kept, _ = journal.read_journal(spark, str(tmp_path / "k.jsonl"))
    state = books.journal_state(kept).first()
    assert (state.entries, state.last_as_of, state.last_equity, state.fills, state.halted) == (3, "2024-01-01 12:00:00", 6.0, 2, 1)
    later = spark.createDataFrame([("a", h) for h in (10, 11, 12, 13)], "symbol string, h int").withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    assert [r.h for r in books.after_restart(later, kept).collect()] == [13]
    text = bundles.dump("variance", {"s": [1.0, 2.0]})
    assert bundles.load(text) == ("variance", {"s": [1.0, 2.0]})
    with pytest.raises(ValueError, match="hash"):
        bundles.load(text.replace("2.0", "3.0"))
    assert provenance.stable_hash({"b": 1.0000000000001, "a": 2}) == provenance.stable_hash({"a": 2, "b": 1.0})
    assert provenance.run_manifest("now", x=1)["run_id"] == provenance.run_manifest("later", x=1)["run_id"]


# --- trading -------------------------------------------------------------------------------------------------------------
def test_limits_and_settings():
    with pytest.raises(ValueError):
        RiskLimits(max_position_weight=0.5)
    with pytest.raises(ValueError, match="valid int"):
        RiskLimits.from_env({"TIDEBOOK_LIMITS__MAX_OPEN_POSITIONS": "many"})
    assert RiskLimits.from_env({"TIDEBOOK_LIMITS__MAX_OPEN_POSITIONS": "3"}).max_open_positions == 3
    with pytest.raises(ValueError):
        Settings.load({"TIDEBOOK__MODE": "live"})
    live = Settings.load({"TIDEBOOK__MODE": "live", "TIDEBOOK__CONFIRM_LIVE": "true"})
    assert live.is_live and live.doctor() and live.round_trip_cost == pytest.approx(0.0016)


def test_unwinding_is_allowed_over_the_ceiling(spark):
    row = ("s", "sell", 0.05, False, 0.0, 0.0, 10.0, 0.2, 1, 0.3, 0.7, None, None)
    columns = "symbol string, action string, target_weight double, halted boolean, daily_loss double, drawdown double, held_quantity double, position_weight double, n_positions int, sector_exposure double, portfolio_exposure double, annualised_volatility double, daily_turnover double"
    out = trading.review(spark.createDataFrame([row, (*row[:1], "buy", *row[2:]), (*row[:3], True, *row[4:])], columns), RiskLimits()).collect()
    assert [r.approved_weight for r in out] == [0.05, 0.0, 0.0]
    assert {c.name for c in out[1].checks if c.status == "fail"} == {"position_weight", "sector_exposure", "portfolio_exposure"}
    assert [c.name for c in out[2].checks if c.status == "fail"] == ["kill_switch"]


def test_reconciliation_status():
    assert books.reconciliation_status(0, 10) == "matched" and books.reconciliation_status(0, 301) == "mismatched"
    assert books.reconciliation_status(0, -1) == "mismatched" and books.reconciliation_status(0, 1, False) == "unavailable"


def test_walk_forward_schedule():
    w = WalkForward(initial_train=250, horizon=5)
    assert (w.gap, w.first) == (5, 256)
    with pytest.raises(ValueError):
        WalkForward(initial_train=250, max_train=100)


def test_regime_estimates_agree(spark):
    from tidebook.operators.stats import regime_scalars

    rng = np.random.default_rng(2)
    r = synthetic.returns("regime", 600, rng)
    rows = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(r)], "symbol string, timestamp int, r double")
    a, b = regime_scalars(rows).first(), estimate_regime(r)
    assert a.persistence == pytest.approx(b.persistence) and a.drift_spread == pytest.approx(b.drift_spread)
    assert a.mean_variance == pytest.approx(b.mean_variance) and a.centre == pytest.approx(b.centre)


def test_processes_have_their_moments():
    rng = np.random.default_rng(9)
    for process in synthetic.PROCESSES:
        r = synthetic.returns(process, 20_000, rng)
        assert abs(r.mean() - 0.05 / 252) < 6e-4 and 0.1 < r.std() * math.sqrt(252) < 0.5
    ar = synthetic.returns("autoregressive", 20_000, rng)
    assert np.corrcoef(ar[1:], ar[:-1])[0, 1] == pytest.approx(0.35, abs=0.03)
