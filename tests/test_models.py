"""The life cycle of the models, the predictives of the variance filter, and the replay against a schedule written out."""

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import account, filters, mixtures, special
from tidebook.functions import features as f
from tidebook.operators import books, folds, life_cycle, series, walk_forward
from tidebook.schema import bar_is_valid
from tidebook.sources import bundles, synthetic
from tidebook.streaming import gate


def window(n: int, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x, z = rng.normal(2, 3, n), rng.normal(0, 1, n)
    return pd.DataFrame(
        {
            "as_of": pd.date_range("2024-01-01", periods=n, freq="h"), "horizon_bars": 5, "x": x, "z": z, "r": rng.normal(0, 0.01, n),
            "volatility_20": 0.2 + 0.1 * rng.random(n), "forward_log_return": 0.01 * x - 0.02 * z + rng.normal(0, 0.02, n),
        }
    )


MAKERS = {
    "regression": lambda: life_cycle.ReturnModel(["x", "z"], 5, forgetting=0.99),
    "scaled": lambda: life_cycle.ReturnModel(["x"], 5, life_cycle.VolatilityScale()),
    "variance": lambda: life_cycle.VolatilityModel(5),
    "regime": lambda: life_cycle.RegimeModel(5),
}


@pytest.mark.parametrize("kind", MAKERS)
def test_life_cycle(kind, tmp_path):
    make, rows = MAKERS[kind], window(300)
    model, at = make(), rows.iloc[-1].to_dict()
    assert not model.can_predict(at) and model.uncertainty() == math.inf
    with pytest.raises(life_cycle.NotFitted):
        model.predict(at)
    with pytest.raises(ValueError, match="at least"):
        model.fit(rows[: model.least - 1])
    assert not model.fitted
    model.fit(rows[:250])
    before, doubt = model.parameters(), model.uncertainty()
    # a window that does not suit leaves the model as it was
    for bad in (rows[::-1], rows.assign(horizon_bars=3), rows.assign(r=np.nan, x=np.nan)):
        with pytest.raises(ValueError):
            model.fit(bad)
    assert model.parameters() == before and model.can_predict(at) and 0 < doubt < math.inf
    with pytest.raises(life_cycle.TooEarly):
        model.update(rows.iloc[100].to_dict())
    with pytest.raises(life_cycle.HorizonMismatch):
        model.predict(at, 3)
    for k in range(250, 300):
        model.update(rows.iloc[k].to_dict())
    assert model.span.n == 300 and model.parameters() != before
    # saved as a bundle, restored, and alike from there on
    family = model.kind
    bundles.save_model(str(tmp_path / "m.json"), family, model.parameters())
    again = make().restore(bundles.load_model(str(tmp_path / "m.json"))[1])
    assert again.predict(at).mixture == model.predict(at).mixture and again.version() == model.version() and again.uncertainty() == model.uncertainty()
    json.dumps(model.parameters())
    later = {**at, "as_of": at["as_of"] + pd.Timedelta("1h")}
    assert again.update(later).predict(at).mixture == model.update(later).predict(at).mixture
    with pytest.raises(life_cycle.HorizonMismatch):
        type(model)(*([["x", "z"]] if family == "regression" else []), horizon=2).restore(before)


def test_updates_and_fits_agree_and_forget():
    rows = window(200)
    model = life_cycle.ReturnModel(["x"], 5, forgetting=0.97).fit(rows[:100])
    held = model.held["centre"], model.held["spread"]
    for k in range(100, 200):
        model.update(rows.iloc[k].to_dict())
    w = 0.97 ** np.arange(199, -1, -1.0)
    d = np.column_stack([np.ones(200), (rows.x - held[0][0]) / held[1][0]])
    y = rows.forward_log_return.to_numpy()
    precision = (d.T * w) @ d + np.eye(2)
    mean, inverse, a, b = model.posterior()
    assert np.allclose(mean, np.linalg.solve(precision, d.T @ (w * y))) and a == pytest.approx(2 + w.sum() / 2)
    assert np.allclose(model.coefficient_covariance(), np.linalg.inv(precision) * b / (a - 1))
    table = model.coefficients().set_index("column")
    assert table.raw["x"] == pytest.approx(table.standardised["x"] / held[1][0])
    at = rows.iloc[-1].to_dict()
    assert table.raw["intercept"] + table.raw["x"] * at["x"] == pytest.approx(model.predict(at).mixture[0][1])


def test_response_scale():
    rows = window(300)
    plain = life_cycle.ReturnModel(["x"], 5, residual_scale=1.0)
    scaled = life_cycle.ReturnModel(["x"], 5, life_cycle.VolatilityScale()).fit(rows)
    s = np.maximum(rows.volatility_20 / 252**0.5, 1e-4)
    plain.fit(rows.assign(forward_log_return=rows.forward_log_return / s))
    at = rows.iloc[7].to_dict()
    (_, m, w, df), (_, m0, w0, df0) = scaled.predict(at).mixture[0], plain.predict(at).mixture[0]
    assert (m, w, df) == pytest.approx((m0 * s[7], w0 * s[7], df0))
    assert scaled.predict(at).epistemic_variance == pytest.approx(plain.predict(at).epistemic_variance * s[7] ** 2)
    assert not scaled.can_predict({"x": 1.0}) and scaled.version() != plain.version()
    with pytest.raises(ValueError):
        scaled.predict({**at, "volatility_20": float("nan")})
    assert life_cycle.VolatilityScale(annualised=False).of(np.array([0.0, 3.0])).tolist() == [1e-4, 3.0]


def test_predictives_of_the_variance_filter():
    rng = np.random.default_rng(4)
    f = filters.VarianceFilter()
    for v in rng.normal(0, 0.015, 400):
        f.observe(v)
    for h in (1, 5):
        parts, inflation = f.predictive(h)
        variance = sum(w * s * s * d / (d - 2) for w, _, s, d in parts)
        assert f.plugin_variance(h) + inflation == pytest.approx(variance, rel=1e-12) and f.realised_mean(h) == pytest.approx(variance, rel=1e-12)
    a, b = f.posterior(evolved=True)
    pick = rng.choice(len(a), 200_000, p=f.weights)
    drawn = b[pick] / rng.gamma(a[pick]) * rng.chisquare(5, len(pick))
    for q in (0.1, 0.5, 0.9):
        assert f.realised_cdf(float(np.quantile(drawn, q)), 5) == pytest.approx(q, abs=0.005)
    low, high = f.volatility_interval(0.9)
    assert f.variance_cdf(low**2) == pytest.approx(0.05) and f.variance_cdf(high**2) == pytest.approx(0.95) and low < 0.015 < high
    assert low < f.expected_volatility() < high and f.disagreement() <= f.uncertainty()
    assert filters.VarianceFilter.load(json.loads(json.dumps(f.dump()))).dump() == f.dump()
    x = np.array([0.1, 1.0, 3.0, 40.0])
    assert special.gamma_inc(np.ones(4), x) == pytest.approx(1 - np.exp(-x)) and special.gamma_inc(np.full(4, 2.0), x) == pytest.approx(1 - np.exp(-x) * (1 + x))


def replayed(rows: pd.DataFrame, horizon: int, warmup: int, refit: int) -> list[tuple]:
    """Every prediction from models fitted and updated for it alone, from a schedule that is written out."""
    first, out, answered, scored = warmup + horizon + 1, [], {}, []
    for i in range(first - 1, len(rows)):
        now = rows.as_of[i]
        known = [j for j in answered if rows.realised_at[j] <= now]
        weights = filters.Reliability({m: float(-np.log(3)) for m in life_cycle.Ensemble.names})
        scored = known
        for j in scored:
            weights.score({m: life_cycle.log_score(rows.forward_log_return[j], parts) for m, (parts, _) in answered[j].items()})
        fitted_at = first - 1 + (i - first + 1) // refit * refit
        stop = fitted_at - horizon  # rows up to horizon + 1 before the bar of the fit
        models = life_cycle.Ensemble("x", horizon)
        models.models["momentum"].fit(rows[:stop].dropna())
        models.models["volatility"].fit(rows[:stop])
        models.models["regime"].fit(rows[:stop])
        for j in known:
            # an outcome is settled before a refit at the same bar, which starts without it
            if j >= stop and rows.realised_at[j] > rows.as_of[fitted_at]:
                models.update(rows.iloc[j].to_dict())
        if not np.isfinite(rows.forward_log_return[i]):
            continue
        answers = models.predict({"x": rows.x[i]})
        parts, epistemic, _ = account.pool(answers, weights.weights())
        answered[i] = answers
        out.append((now, epistemic, weights.weights()["momentum"], account.moments(parts)[0]))
    return out


def test_replay_against_its_schedule_with_outcomes_missing(spark):
    n, horizon, warmup, refit = 210, 4, 120, 17
    rows = window(n, 3).drop(columns="horizon_bars")
    rows["realised_at"] = rows.as_of + pd.Timedelta(hours=horizon)
    rows.loc[[40, 133, 150, 151, 200], "forward_log_return"] = np.nan
    want = replayed(rows, horizon, warmup, refit)
    both = pd.concat([rows.assign(symbol="a"), rows[:60].assign(symbol="short")]).rename(columns={"as_of": "timestamp"})
    table = spark.createDataFrame(both).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "realised_at")})
    got = walk_forward.replay(table.repartition(3), "x", horizon, warmup, refit).orderBy("as_of").collect()
    assert len(got) == len(want) == n - (warmup + horizon) - 4
    for g, (as_of, epistemic, w, mean) in zip(got, want, strict=True):
        total = sum(c.w for c in g.mixture)
        assert g.as_of == as_of and g.epistemic_variance == pytest.approx(epistemic, rel=1e-9) and g.w_momentum == pytest.approx(w, rel=1e-9)
        assert sum(c.w * c.loc for c in g.mixture) / total == pytest.approx(mean, rel=1e-9, abs=1e-12)
    counts = {r.symbol: (r.n_examples, r.n_skipped) for r in walk_forward.skipped(table).collect()}
    assert counts == {"a": (210, 5), "short": (60, 1)}
    with pytest.raises(Exception, match="two rows"):
        walk_forward.replay(table.unionByName(table.limit(1)), "x", horizon, warmup, refit).count()
    with pytest.raises(Exception, match="label is not of"):
        walk_forward.replay(table.withColumn("horizon_bars", F.lit(3)), "x", horizon, warmup, refit).count()
    with pytest.raises(ValueError):
        walk_forward.replay(table, "x", horizon, 119, refit)


def test_folds_carry_their_state_over_batches(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("k"), (60_000 - F.col("id")).alias("t"))

    def step(state, row):
        state[0] += row.t
        return [(row.k, row.t, state[0])] if row.t % 10_000 == 0 else []

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        out = folds.fold(rows, "k", ["t"], lambda first: [0, first.k], step, "k string, t long, total long", lambda s: [(s[1], -1, s[0])]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert folds.names_of("a array<struct<x:int,y:int>>, b long") == ["a", "b"]
    for r in out:
        want = [t for t in range(1, 60_001) if str((60_000 - t) % 3) == r.k and (r.t < 0 or t <= r.t)]
        assert r.total == sum(want)
    assert len(out) == 6 + 3


def test_rebuilt_equity_must_agree_with_the_journal(spark):
    lines = [(1, "bar", "a", "t1", "buy", 10.0, 5.0, 1.0, 1000.0, 5.0, "o1"), (2, "bar", "a", "t2", "buy", 0.0, None, 0.0, None, 6.0, None), (3, "bar", "b", "t3", "sell", 4.0, 2.0, 0.5, 1007.0, 2.0, "o2")]
    entries = spark.createDataFrame(lines, "line long, event string, symbol string, as_of string, action string, filled double, fill_price double, fees double, equity double, close double, order_id string")
    found = books.rebuilt_equity(entries, 1000.0).first()
    assert (found.cash, found.equity, found.recorded) == (1000 - 51 + 7.5, 956.5 + 60 - 8, 1007.0)
    assert books.rebuild_verdict(entries, 0, 1000.0) == (True, [])
    ok, problems = books.rebuild_verdict(entries, 0, 1100.0)
    assert not ok and "disagrees" in problems[0]


def test_fit_reports_leave_short_series_out(spark):
    rows = window(400).drop(columns="horizon_bars").rename(columns={"as_of": "timestamp"})
    both = pd.concat([rows.assign(symbol="a"), rows[:304].assign(symbol="short")])
    table = spark.createDataFrame(both).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    report, fitted = walk_forward.fit_report(table, "x", "forward_log_return", walk_forward.WalkForward())
    assert [(r.symbol, r.n_examples, r.n_scored) for r in report.collect()] == [("a", 400, 145)]
    f = fitted.first()
    d = np.column_stack([np.ones(400), rows.x])
    want = np.linalg.solve(d.T @ d + np.eye(2), d.T @ rows.forward_log_return)
    assert [r.symbol for r in fitted.collect()] == ["a"] and (f.m0, f.m1) == pytest.approx(tuple(want))


def test_generators_tell_their_truth(spark):
    rng = np.random.default_rng(0)
    r, states = synthetic.Process("regime", persistence=0.9, state_volatilities=(0.5, 3.0, 1.0)).path(60_000, rng)
    assert [np.std(r[states == k]) for k in range(3)] == pytest.approx([x * 0.2 / 252**0.5 for x in (0.5, 3.0, 1.0)], rel=0.05)
    assert np.mean(states[1:] == states[:-1]) == pytest.approx(0.9 + 0.1 * sum(p * p for p in filters.STATIONARY), abs=0.01)
    r, sigma = synthetic.Process("stochastic_volatility", drift=0.0).path(60_000, rng)
    assert np.std(r / sigma) == pytest.approx(1, abs=0.02) and np.std(np.log(sigma)) == pytest.approx(0.15 / (1 - 0.97**2) ** 0.5, rel=0.1)
    r, mean = synthetic.Process("autoregressive", phi=0.5, drift=0.0).path(60_000, rng)
    assert np.corrcoef(r, mean)[0, 1] == pytest.approx(0.5, abs=0.02) and np.std(r) == pytest.approx(0.2 / 252**0.5, rel=0.03)
    with pytest.raises(ValueError):
        synthetic.Process("regime", persistence=1.0)
    quiet, loud = (np.log(synthetic.bars_of("a", r[:2000], np.random.default_rng(1), datetime(2020, 1, 1), volume_beta=b).volume) for b in (0, 50))
    assert np.corrcoef(loud, np.abs(r[:2000]))[0, 1] > 0.3 > abs(np.corrcoef(quiet, np.abs(r[:2000]))[0, 1])
    one = spark.createDataFrame([("a",)], "symbol string")
    out = synthetic.simulate(one, 50, synthetic.Process("regime"), truth=True)
    assert {x.true_value for x in out.collect()} <= {0.0, 1.0, 2.0} and out.where(~bar_is_valid()).count() == 0


def test_sweeps_over_generators(spark):
    laws = {"gaussian": synthetic.Process(), "regime": synthetic.Process("regime")}
    out = walk_forward.calibration_sweep(laws, [1, 2], 420, spark, walk_forward.WalkForward(initial_train=120)).collect()
    assert sorted((r.process, r.seed) for r in out) == [(p, k) for p in laws for k in (1, 2)] and all(r.n > 200 and 0 < r.brier < 0.5 for r in out)


def test_mixtures_as_distributions(spark):
    parts = "array(named_struct('w', 0.4D, 'loc', -1D, 'scale', 1D, 'df', 5D), named_struct('w', 0.6D, 'loc', 2D, 'scale', 0.5D, 'df', 30D))"
    rows = spark.range(4000).select("id", F.expr(parts).alias("m"))
    m = F.col("m")
    one = rows.limit(1).select(mixtures.credible_interval(m, 0.8).alias("ci"), mixtures.cdf(m, 0.3).alias("c"), mixtures.ccdf(m, 0.3).alias("cc"), mixtures.pdf(m, 0.3).alias("p"), mixtures.logpdf(m, 0.3).alias("lp")).first()
    assert one.c + one.cc == pytest.approx(1) and one.p == pytest.approx(math.exp(one.lp)) and one.ci.level == 0.8
    drawn = rows.select(mixtures.draw(m, 7, F.col("id")).alias("x")).toPandas().x
    assert np.mean(drawn < one.ci.lower) == pytest.approx(0.1, abs=0.02) and np.mean(drawn < one.ci.upper) == pytest.approx(0.9, abs=0.02)
    assert rows.select(mixtures.draw(m, 7, F.col("id")).alias("x")).toPandas().x.equals(drawn)
    w = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    got = spark.range(1).select(mixtures.most_likely(["a", "b", "c"], w), mixtures.probability_of(["a", "b", "c"], w, "c"), mixtures.probability_of(["a"], w, "z")).first()
    assert tuple(got) == ("b", 0.3, 0.0)


def test_faults_and_staleness_of_vectors(spark):
    walked = spark.createDataFrame([("a", 1, 5, None, None), ("a", 2, 30, 1.0, None), ("a", 3, 30, 1.0, 2.0)], "symbol string, timestamp int, n_bars int, momentum_20_1 double, relative_volume_20 double")
    found = [f.momentum(20, 1), f.relative_volume(20)]
    got = {r.timestamp: r.faults for r in series.design_faults(walked, found, ["momentum_20_1", "relative_volume_20"]).collect()}
    assert got == {1: ["momentum_20_1: warming up", "relative_volume_20: warming up"], 2: ["relative_volume_20: undefined"]}
    assert series.design_faults(walked, found, ["nope"]).first().faults == ["nope: never requested"]
    vectors = spark.sql("SELECT timestamp_ntz'2024-01-01 02:00:00' AS as_of, timestamp_ntz'2024-01-01 00:30:00' AS data_as_of")
    assert series.staleness(vectors).first().stale_seconds == 5400
    own, other = gate.foreign(spark.createDataFrame([("a",), ("b",), (None,)], "symbol string"), ["a"])
    assert own.count() == 1 and other.count() == 2
