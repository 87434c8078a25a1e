"""Scans over chunks against the folds that they replace, row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.functions import filters
from tidebook.operators import books, scans, stats

RETURNS = "symbol string, day int, r double"


def returns(spark, series):
    rows = [(s, k, None if np.isnan(x) else float(x)) for s, xs in series.items() for k, x in enumerate(xs)]
    stamp = (F.lit("1990-01-01").cast("date") + F.col("day")).cast("timestamp_ntz").alias("timestamp")
    return spark.createDataFrame(rows, RETURNS).select("symbol", stamp, "r")


def by_symbol(df):
    out = {}
    for r in df.orderBy("symbol", "timestamp").collect():
        out.setdefault(r.symbol, []).append(r[2:])
    return {s: np.array(x, float) for s, x in out.items()}


def series(seed, n):
    rng = np.random.default_rng(seed)
    out = rng.normal(0, 0.02, n) * np.exp(0.5 * np.sin(np.arange(n) / 90))
    out[rng.random(n) < 0.05] = np.nan
    return out


def test_decayed_sums_and_products():
    rng = np.random.default_rng(1)
    values, factor, start = rng.normal(size=(77, 3)), np.array([0.9, 0.99, 1.0]), np.array([1.0, -2.0, 3.0])
    now, want = start, []
    for v in values:
        now = factor * now + v
        want.append(now)
    np.testing.assert_allclose(scans.decayed(values, factor, start), want, rtol=1e-12, atol=1e-12)
    assert scans.decayed(values[:0], factor, start).shape == (0, 3)
    matrices = rng.random((50, 3, 3)) * np.exp(rng.normal(0, 40, 50))[:, None, None]
    running, scale = scans.products(matrices)
    now, log = np.eye(3), 0.0
    for m, got, at in zip(matrices, running, scale, strict=True):
        now = m @ now
        top = now.max()
        now, log = now / top, log + np.log(top)
        np.testing.assert_allclose(got, now, rtol=1e-10)
        assert at == pytest.approx(log, rel=1e-12)


def test_variance_scan_equals_the_fold(spark):
    """Over chunk ends, gaps, a calm and a wild stretch that puts weights on the floor, and short series."""
    wild = series(2, 5_000)
    wild[2_500:2_900] = 1e-9  # so calm that the slow discounts lose all weight
    wild[2_900:2_960] = 3.0
    data = {"a": series(1, 4_200), "b": wild, "c": np.array([np.nan, 0.01]), "d": np.array([np.nan])}
    got = by_symbol(stats.variance_filter(returns(spark, data), 0.02, 5))
    floored = 0
    for symbol, xs in data.items():
        f = filters.VarianceFilter(b0=0.02**2)
        want = []
        for x in xs:
            f.observe(None if np.isnan(x) else x)
            floored += f.logs.min() <= filters.LOG_FLOOR + 1e-6
            want.append((
                f.noise_variance(), f.uncertainty(), f.effective_n(), f.expected_discount(), f.entropy(), f.n_seen, f.n_skipped,
                f.plugin_variance(5), f.predictive(5)[1], f.realised_mean(5), f.predictive_df(),
            ))
        np.testing.assert_allclose(got[symbol], want, rtol=1e-8, atol=1e-13)
    assert floored > 100


def test_regime_scan_equals_the_fold(spark):
    data = {"a": series(3, 300), "b": series(4, 33), "c": np.array([np.nan, 0.5])}
    scalars = spark.createDataFrame(
        [(s, 0.0003, 0.0004, 0.95, 0.0004, 0.5, 250) for s in data],
        "symbol string, centre double, drift_spread double, persistence double, mean_variance double, dispersion double, n_rows int",
    )
    for size in (16, 2048):
        got = by_symbol(scans.regime_scan(returns(spark, data), scalars, size))
        for symbol, xs in data.items():
            f = filters.RegimeFilter(filters.RegimeParameters(0.0003, 0.0004, 0.95, 0.0004, 0.5, 250))
            want = []
            for x in xs:
                f.observe(None if np.isnan(x) else x)
                want.append((*f.belief, f.log_likelihood))
            np.testing.assert_allclose(got[symbol], want, rtol=1e-9, atol=1e-12)


def book(rows):
    held = filters.Book(0.0)
    for symbol, side, quantity, price in rows:
        held.apply(symbol, side, quantity, price, 0.0)
    return held.positions


def test_positions_equal_the_fold(spark):
    """Positions that open, grow, shrink, close, cross zero, and stay flat at the end."""
    rng = np.random.default_rng(5)
    rows = [(f"s{rng.integers(4)}", "buy" if rng.random() < 0.5 else "sell", float(rng.integers(1, 6)), float(rng.uniform(90, 110))) for _ in range(800)]
    rows += [("flat", "buy", 0.1, 10.0), ("flat", "buy", 0.2, 11.0), ("flat", "sell", 0.3, 12.0), ("one", "sell", 2.0, 7.0)]
    entries = spark.createDataFrame(
        [("bar", s, f"2026-01-{1 + k // 100:02d} 10:00:{k % 100:03d}", f"o{k:05d}", side, q, p) for k, (s, side, q, p) in enumerate(rows)],
        "event string, symbol string, as_of string, order_id string, action string, filled double, fill_price double",
    )
    want = book(rows)
    for size in (1, 7, 2048):
        fills = entries.select("symbol", "as_of", "order_id", F.when(F.col("action") == "buy", F.col("filled")).otherwise(-F.col("filled")).alias("delta"), F.col("fill_price").alias("price"))
        out = scans.position_scan(fills, ["as_of", "order_id"], F.substring("as_of", 1, 10), size).collect()
        got = {r.symbol: (r.quantity, r.average_price) for r in out}
        assert got.keys() == want.keys() and "flat" not in got
        for s, pair in want.items():
            assert got[s] == pytest.approx(pair, rel=1e-9)
    assert {r.symbol for r in books.rebuild_positions(entries).collect()} == set(want)
    assert books.rebuild_positions(entries.limit(0)).count() == 0
    assert "Python" not in books.rebuild_positions(entries)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("longest,forgetting", [(None, 1.0), (60, 1.0), (None, 0.97), (60, 0.97), (47, 0.9)])
def test_wide_walk_equals_fits_one_by_one(spark, longest, forgetting):
    """Any number of columns, windows that do and do not end with a refit, and chunks of few refits."""
    from tidebook.operators.stats import solve_posterior
    from tidebook.operators.walk_forward import WalkForward, discounted_sums, regression_walk_wide

    rng = np.random.default_rng(9)
    n, names = 150, ["x0", "x1", "x2", "x3"]
    values = rng.normal(0, 1, (n, 4))
    y = values @ [0.5, -0.3, 0.2, 0.0] + rng.normal(0, 0.1, n)
    rows = [("a", k, *map(float, values[k]), float(y[k])) for k in range(n)] + [("short", k, 1.0, 2.0, 3.0, 4.0, 5.0) for k in range(20)]
    df = spark.createDataFrame(rows, "symbol string, day int, x0 double, x1 double, x2 double, x3 double, y double").withColumn(
        "timestamp", (F.lit("2020-01-01").cast("date") + F.col("day")).cast("timestamp_ntz")
    )
    config = WalkForward(initial_train=40, refit_every=7, horizon=3, max_train=longest)
    out = {r.day: r for r in regression_walk_wide(df, names, "y", config, forgetting).collect()}
    assert sorted(out) == list(range(config.first - 1, n))
    small = discounted_sums(scans.placed(df, ["timestamp"], F.lit("")), names, "y", config, forgetting, periods=3)
    told = {r.train_end: r for r in small.where("symbol = 'a'").collect()}
    for day, r in out.items():
        end = 40 + (day + 1 - config.first) // 7 * 7
        start = 0 if longest is None else max(0, end - longest)
        w = forgetting ** np.arange(end - start - 1, -1, -1)
        x, t = values[start:end], y[start:end]
        sums = {"n": end - start, "weight": w.sum(), "yy": (w * t * t).sum()}
        sums |= {f"xy_{i}": (w * x[:, i] * t).sum() for i in range(4)}
        sums |= {f"xx_{i}_{j}": (w * x[:, i] * x[:, j]).sum() for i in range(4) for j in range(i, 4)}
        for c, v in sums.items():
            assert told[end][c] == pytest.approx(v, rel=1e-9, abs=1e-9)
        fit = solve_posterior(sums, 4)
        at, inverse = values[day], np.linalg.inv(np.reshape(fit["precision"], (4, 4)))
        lev = at @ inverse @ at
        assert (r.train_end, r.train_rows, r.df) == (end, end - start, pytest.approx(2 * fit["shape"]))
        assert r.loc == pytest.approx(at @ fit["mean"], rel=1e-8) and r.scale == pytest.approx(np.sqrt(fit["rate"] / fit["shape"] * (1 + lev)), rel=1e-7)
