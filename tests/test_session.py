"""The paper session step by step, and its rulings against the column forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.config import RiskLimits
from tidebook.functions import account
from tidebook.operators import trading
from tidebook.streaming import ohlcv, session

LIMITS = RiskLimits(min_probability_positive=0.52, min_daily_turnover=1e6, max_annualised_volatility=2.0)


def trending(n: int, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    r = np.zeros(n)
    for k in range(1, n):
        r[k] = 0.55 * r[k - 1] + 0.004 * rng.standard_normal()
    return pd.DataFrame(
        {"symbol": "a", "bar_end": pd.date_range("2026-01-05 10:00", periods=n, freq="1D"), "close": 100 * np.exp(r.cumsum()), "volume": 1e6}
    )


def run(bars: pd.DataFrame, **config) -> pd.DataFrame:
    state = session.State("a", session.Config(**({"warmup": 60, "refit_every": 40, "limits": LIMITS} | config)))
    return session._events(state, bars)


def test_session_decides_fills_and_keeps_its_books():
    out = run(trending(220))
    kinds = out.event.value_counts()
    acted = out[out.action.notna()]
    # the first example has 21 lags and a return behind it and its outcome five bars on
    assert kinds.session_started == 1 and out[out.event == "refit"].n_rows.tolist() == [60, 100, 140, 180]
    assert out[out.event == "refit"].bar_end.iloc[0] == trending(220).bar_end[60 + 21 + 5 - 1]
    assert set(acted.action) >= {"buy", "sell"} and (acted.filled != 0).sum() > 10
    assert kinds.settled == 220 - 5 and out[out.event == "settled"].u.between(0, 1).all()
    fused = acted[["w_momentum", "w_volatility", "w_regime"]]
    assert np.allclose(fused.sum(axis=1).astype(float), 1) and fused.w_momentum.astype(float).nunique() > 10
    cash, held = 1e6, 0.0
    for x in acted[acted.filled != 0].itertuples():
        cash -= x.filled * x.fill_price + x.fees
        held += x.filled
        assert x.cash == pytest.approx(cash) and x.position == pytest.approx(held)
        assert x.equity == pytest.approx(cash + held * x.close)
    opened = out[out.event != "session_started"].groupby(out.bar_end.dt.date).day_start_equity.first().astype(float)
    closed = out.groupby(out.bar_end.dt.date).equity.last().astype(float)
    assert opened.iloc[1:].to_numpy() == pytest.approx(closed.iloc[:-1].to_numpy())


def test_state_round_trips_and_skips_what_it_handled():
    bars, config = trending(150), session.Config(warmup=60, refit_every=40, limits=LIMITS)
    whole = session._events(session.State("a", config), bars)
    one = session.State("a", config)
    first = session._events(one, bars[:110])
    two = session.State.restore(one.dump(), "a", config)
    rest = session._events(two, bars[100:])
    assert (rest.event == "already_handled").sum() == 10
    pieces = pd.concat([first, rest[rest.event != "already_handled"]]).reset_index(drop=True)
    pd.testing.assert_frame_equal(pieces, whole, check_dtype=False)


def test_due_predictions_wait_for_a_usable_bar():
    bars = trending(60)
    bars.loc[[30, 31], "close"] = [np.nan, -1.0]
    out = run(bars)
    assert out[out.event == "halted"].failing.tolist() == ["price", "price"]
    settled = out[out.event == "settled"]
    # 58 usable bars were predicted from; the last five usable ones and none else are open
    assert len(settled) == 58 - 5
    late = settled[settled.bar_end == bars.bar_end[32]]
    assert late.settled_bar.tolist() == bars.bar_end[[25, 26, 27]].tolist()
    assert late.outcome.astype(float).tolist() == pytest.approx([math.log(bars.close[32] / bars.close[k]) for k in (25, 26, 27)])


def test_a_bar_after_silence_halts():
    bars = trending(120)
    bars.loc[100:, "bar_end"] += pd.Timedelta(days=5)
    out = run(bars)
    halted = out[out.event == "halted"]
    assert halted.failing.tolist() == ["feed"] and halted.bar_end.iloc[0] == bars.bar_end[100]
    assert halted.bar_end.iloc[0] not in set(out[out.action.notna()].bar_end)


def test_scalar_rulings_equal_the_column_forms(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        parts = [(float(w), float(rng.normal(0, 0.03)), float(rng.uniform(0.005, 0.05)), float(rng.uniform(3, 40))) for w in rng.dirichlet([1, 1])]
        variance = account.moments(parts)[1]
        a = account.Account(1e6, float(rng.choice([0, 0, 400, -300, 600])), 100.0, 100.0, 0.0, 0.0, "d", 1e6 * float(rng.uniform(0.97, 1.03)))
        a.peak = a.equity * float(rng.choice([1.0, 1.1, 1.25]))
        volatility, turnover = float(rng.uniform(0.1, 0.8)), float(rng.uniform(2e7, 3e8))
        epistemic = variance * float(rng.uniform(0, 0.7))
        action, reason, target = account.decide(parts, epistemic, RiskLimits(), trading.FLOOR_DOWNSIDE, trading.TAIL)
        approved, failed = a.review(action, target, volatility, turnover, RiskLimits())
        weight = abs(a.quantity * 100) / a.equity
        rows.append(
            (k, [dict(zip(("w", "loc", "scale", "df"), p)) for p in parts], variance, epistemic / variance, volatility, turnover, a.quantity, weight,
             max(0.0, (a.day_start - a.equity) / a.day_start), a.drawdown, action, reason, target, approved, ",".join(failed))
        )
    names = "k long, mixture array<struct<w:double,loc:double,scale:double,df:double>>, variance double, epistemic_share double, annualised_volatility double, daily_turnover double, held_quantity double, position_weight double, daily_loss double, drawdown double, want_action string, want_reason string, want_target double, want_approved double, want_failed string"
    held = spark.createDataFrame(rows, names).withColumns(
        {"as_of": F.lit("2026-01-01").cast("timestamp"), "now": F.lit(None).cast("timestamp"), "halted": F.lit(False),
         "n_positions": (F.col("held_quantity") != 0).cast("int"), "sector_exposure": F.col("position_weight"), "portfolio_exposure": F.col("position_weight")}
    )
    got = trading.review(trading.decide(trading.tails(held, RiskLimits()), RiskLimits()), RiskLimits()).collect()
    for r in got:
        assert (r.action, r.reason) == (r.want_action, r.want_reason)
        assert r.target_weight == pytest.approx(r.want_target, abs=1e-9) and r.approved_weight == pytest.approx(r.want_approved, abs=1e-9)
        assert ",".join(c["name"] for c in r.checks if c["status"] == "fail") == r.want_failed
    assert len({r.action for r in got}) == 3 and len({r.want_failed for r in got}) > 4 and any(r.approved_weight > 0 for r in got)


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    """Six batches with refits in them: events are those of one run, the value keeps its size, examples and pending are lists."""
    bars, config = trending(170), {"warmup": 60, "refit_every": 40, "limits": LIMITS}
    whole = session._events(session.State("a", session.Config(**config)), bars)
    schema = "symbol string, bar_end timestamp, close double, volume double"
    sizes = {}
    for first, last in ((0, 90), (90, 100), (100, 101), (101, 130), (125, 150), (150, 170)):
        spark.createDataFrame(bars[first:last], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.session_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), **config)
        ohlcv.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "checkpoint"))
        sizes[last] = len(held("session").selectExpr("value.state").first().state)
    got = spark.read.parquet(str(tmp_path / "out")).where("event <> 'already_handled'").toPandas()
    keys = ["bar_end", "event", "settled_bar"]
    a, b = (x.assign(settled_bar=pd.to_datetime(x.settled_bar)).sort_values(keys).reset_index(drop=True)[session.COLUMNS] for x in (got, whole))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)
    assert (whole.event == "refit").sum() == 3
    # digits of numbers differ by a little; 70 more bars add none
    assert abs(sizes[170] - sizes[100]) < 0.05 * sizes[100]
    assert held("examples").count() == 170 - 21 - 5 and held("pending").count() == 5
